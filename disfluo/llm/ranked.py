"""Ranked lexical search: each item's best documents by integer impacts, found score at a time.

Every task turns its documents into blocks of postings of the items' terms. Postings of a block are grouped by term and exact
quantised weight, so that a group is one impact for an item. An item takes the groups of its terms in descending order of impact
and adds each to the scores of the group's documents; what a document can still gain is at most the sum of its terms' next
impacts. The item stops when these bounds prove which documents may be among its best (those of the task's blocks before
count as well), and completes the scores of these alone. Tasks give their best documents for each item, and these meet in
one ranking.

Defined results: null and empty texts have no terms, so such documents are not counted and never found, and such items find
nothing; an item's term counts once; items alike in id and terms are one item, items with the same id and other terms are
ranked on their own; repeated documents are documents of their own; of equal scores the lower doc_id comes first, a null id
last; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from disfluo.llm.common import pieces_of, read, short_batches, squeezed, stable, word_hashes

#: A term's characters: ASCII letters and digits, and everything past ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OUTSIDE = np.array([c < 0x80 and not chr(c).isalnum() for c in range(256)])
_LOWERED = np.array([c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)], dtype=np.uint8)


@dataclass(frozen=True)
class Search:
    """best: documents for each item; block_bytes: text in a block of postings, about; items_bytes: text of the items that are
    searched for at once (more of them take further passes)."""

    best: int = 50
    block_bytes: int = 8 << 20
    items_bytes: int = 16 << 20


def term_hashes(text: bytes) -> Iterator[np.ndarray]:
    """64-bit hashes of a text's terms with repeats, a piece at a time."""
    for _, piece in pieces_of(np.frombuffer(text, dtype=np.uint8), outside=_OUTSIDE):
        yield word_hashes(_LOWERED[piece], _OUTSIDE)[0]


@dataclass
class Items:
    """A bounded number of items: their ids, their terms' hashes (sorted, all items together) and each item's places among them."""

    ids: list[int | None]
    vocabulary: np.ndarray
    terms: list[np.ndarray]

    @staticmethod
    def of(rows: list) -> Items:
        hashes = [np.unique(np.concatenate([np.zeros(0, np.uint64), *(h for t in r["terms"] for h in term_hashes(t.encode()))])) for r in rows]
        vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]))
        return Items([r["item_id"] for r in rows], vocabulary, [np.searchsorted(vocabulary, h) for h in hashes])


BLOCK = [("ids", pa.binary()), ("nulls", pa.binary()), ("lens", pa.binary()), ("term", pa.binary()), ("doc", pa.binary()), ("tf", pa.binary()), ("n_postings", pa.int64()), ("n_docs", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64()), ("df", pa.list_(pa.struct([("t", pa.int32()), ("c", pa.int64())])))]
BLOCK_SCHEMA = "ids binary, nulls binary, lens binary, term binary, doc binary, tf binary, n_postings long, n_docs long, docs long, tokens long, df array<struct<t: int, c: long>>"


def postings(docs: DataFrame, vocabulary: np.ndarray, cfg: Search) -> DataFrame:
    """Blocks of postings of the vocabulary's terms, ordered by term and document, with the counts that weights need."""

    def count(text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
        found, n = [], 0
        for h in term_hashes(text):
            n += len(h)
            at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            found.append(at[vocabulary[at] == h])
        term, tf = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
        return term, tf, n

    def packed(ids: list, got: list[tuple]) -> pa.RecordBatch:
        term = np.concatenate([g[0] for g in got]).astype(np.int32)
        doc = np.repeat(np.arange(len(got), dtype=np.int32), [len(g[0]) for g in got])
        tf = np.concatenate([g[1] for g in got]).astype(np.int32)
        lens = np.array([g[2] for g in got], dtype=np.int64)
        by = np.argsort(term, kind="stable")
        seen, df = np.unique(term, return_counts=True)
        arrays = (np.array([i or 0 for i in ids], dtype=np.int64), np.array([i is None for i in ids]), lens, term[by], doc[by], tf[by])
        row = [squeezed(a.tobytes()) for a in arrays] + [len(term), len(ids), int((lens > 0).sum()), int(lens.sum()), [{"t": t, "c": c} for t, c in zip(seen.tolist(), df.tolist())]]
        return pa.RecordBatch.from_pylist([dict(zip((n for n, _ in BLOCK), row))], schema=pa.schema(BLOCK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, got, size = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                text = text.as_py() or b""
                ids.append(i)
                got.append(count(text))
                size += len(text) + 24
                if size >= cfg.block_bytes:
                    yield packed(ids, got)
                    ids, got, size = [], [], 0
        if ids:
            yield packed(ids, got)

    narrow = short_batches(docs).select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").cast("binary").alias("text"))
    return stable(narrow.mapInArrow(run, BLOCK_SCHEMA))


class Groups:
    """A block's postings, grouped by term and exact quantised weight, the largest weight of a term first."""

    def __init__(self, row: dict, total_docs: int, total_tokens: int):
        n = row["n_postings"]

        def array(name: str, kind: type, size: int) -> np.ndarray:
            return np.frombuffer(pa.decompress(row[name], decompressed_size=size * np.dtype(kind).itemsize, codec="zstd", asbytes=True), dtype=kind) if size else np.zeros(0, kind)

        null = pa.decompress(row["nulls"], decompressed_size=row["n_docs"], codec="zstd", asbytes=True)
        self.null = np.frombuffer(null, dtype=bool)
        self.ids, lens = array("ids", np.int64, len(self.null)), array("lens", np.int64, len(self.null))
        term, doc, tf = array("term", np.int32, n), array("doc", np.int32, n), array("tf", np.int32, n).astype(np.int64)
        if len(lens) and 50 * int(lens.max()) * total_docs < 1 << 63:
            m = 50 + 50 * lens * total_docs // max(1, total_tokens)
        else:
            m = np.array([50 + 50 * x * total_docs // max(1, total_tokens) for x in lens.tolist()], dtype=np.int64)
        q = 1_000_000_000 * tf // (1000 * tf + 20 * m[doc])
        by = np.lexsort((doc, -q, term))
        term, q, self.doc = term[by], q[by], doc[by]
        first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (q[1:] != q[:-1])))) if n else np.zeros(0, np.int64)
        self.start, self.end = first, np.append(first[1:], n)
        self.term, self.q = term[first], q[first]

    def of(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and past-the-end groups of each term."""
        return np.searchsorted(self.term, terms, "left"), np.searchsorted(self.term, terms, "right")


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = end - start
    return np.arange(n.sum()) + np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n)


def score_at_a_time(groups: Groups, terms: np.ndarray, weights: np.ndarray, k: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents of the block that may be among the item's k best, their whole scores, and how many postings were added up.

    known: the best scores found so far, descending; a document must reach the k-th of them.
    """
    none = np.zeros(0, np.int64)
    least = int(known[k - 1]) if len(known) >= k else 1
    a, b = groups.of(terms)
    has = b > a
    a, b, weights = a[has], b[has], weights[has]
    if not len(a) or int((weights * groups.q[a]).sum()) < least:
        return none, none, 0
    of = np.repeat(np.arange(len(a)), b - a)
    at = _ranges(a, b)
    impact = weights[of] * groups.q[at]
    by = np.argsort(-impact, kind="stable")
    of, at, impact = of[by], at[by], impact[by]
    scores, done, step, added = np.zeros(len(groups.ids), np.int64), 0, 64, 0
    rest = np.zeros(len(a), np.int64)  # what each term can still add
    while True:
        upto = min(done + step, len(at))
        while upto < len(at) and impact[upto] == impact[upto - 1]:
            upto += 1  # groups of one impact are taken together
        docs = groups.doc[_ranges(groups.start[at[done:upto]], groups.end[at[done:upto]])]
        scores += np.bincount(docs, weights=np.repeat(impact[done:upto], (groups.end - groups.start)[at[done:upto]]), minlength=len(scores)).astype(np.int64)
        added, done, step = added + len(docs), upto, 2 * step
        rest[:] = 0
        last, where = np.unique(of[done:], return_index=True)
        rest[last] = impact[done:][where]  # the first group left of a term has its largest impact
        bound = int(rest.sum())
        best = scores[scores > 0]
        best = np.concatenate((best, known[:k]))
        kth = int(np.partition(best, len(best) - k)[len(best) - k]) if len(best) >= k else 1
        may = np.flatnonzero((scores > 0) & (scores + bound >= max(kth, least)))
        if done == len(at):
            return may, scores[may], added
        if bound < max(kth, least) and len(may) <= 4 * k:
            break  # no other document can be among the best: neither one that was met, by its own bound, nor one that was not
    chosen = np.zeros(len(scores), dtype=bool)
    chosen[may] = True
    docs = groups.doc[_ranges(groups.start[at[done:]], groups.end[at[done:]])]
    mine = chosen[docs]
    gains = np.repeat(impact[done:], (groups.end - groups.start)[at[done:]])[mine]
    np.add.at(scores, docs[mine], gains)
    return may, scores[may], added


@dataclass
class Best:
    """An item's best documents so far."""

    scores: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    null: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray, k: int) -> None:
        s, i, n = np.concatenate((self.scores, scores)), np.concatenate((self.ids, ids)), np.concatenate((self.null, null))
        by = np.lexsort((i, n, -s))[:k]
        self.scores, self.ids, self.null = s[by], i[by], n[by]


def _searched(docs: DataFrame, items: Items, cfg: Search) -> DataFrame:
    """q (an item's number), doc_id, score: each task's best documents for each item."""
    blocks = postings(docs, items.vocabulary, cfg)
    total = blocks.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
    n_docs, n_tokens, df = total["docs"], total["tokens"], np.zeros(len(items.vocabulary), np.int64)
    for r in blocks.select(F.explode("df").alias("x")).groupBy("x.t").agg(F.sum("x.c").alias("c")).collect():  # one row for each term of the items at most
        df[r["t"]] = r["c"]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], dtype=np.int64)
    per_item = [(t, weight[t]) for t in items.terms]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Best() for _ in per_item]
        for batch in batches:
            for row in batch.to_pylist():
                groups = Groups(row, n_docs, n_tokens)
                for own, (terms, weights) in zip(found, per_item):
                    at, scores, _ = score_at_a_time(groups, terms, weights, cfg.best, own.scores)
                    if len(at):
                        own.add(scores, groups.ids[at], groups.null[at], cfg.best)
        for q, own in enumerate(found):
            if len(own.scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own.scores), q, np.int32)), pa.array(own.ids, mask=own.null), pa.array(own.scores)], ["q", "doc_id", "score"])

    return blocks.select(*[n for n, _ in BLOCK[:8]]).mapInArrow(run, "q int, doc_id long, score long")


def search(docs: DataFrame, benchmark: DataFrame, cfg: Search = Search()) -> DataFrame:
    """item_id, rank, doc_id, score of each item's best documents."""
    lowered = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    terms = F.array_sort(F.array_distinct(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0)))).alias("terms")
    asked = stable(benchmark.select(F.col("item_id").cast("long").alias("item_id"), terms).filter(F.size("terms") > 0).distinct())
    size = asked.agg(F.sum(F.expr("aggregate(terms, 0L, (n, t) -> n + octet_length(t) + 9)")).alias("b")).first()["b"] or 0
    parts, out = max(1, -(-size // cfg.items_bytes)), None
    for k in range(parts):
        rows = asked.filter(F.pmod(F.xxhash64("item_id", "terms"), F.lit(parts)) == k).collect()  # about items_bytes of the items
        items = Items.of(sorted(rows, key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["terms"])))
        if not items.ids:
            continue
        number = docs.sparkSession.createDataFrame(list(enumerate(items.ids)), "q int, item_id long")
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        got = _searched(docs, items, cfg).withColumn("rank", place).filter(F.col("rank") <= cfg.best)
        got = got.join(F.broadcast(number), "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = got if out is None else out.unionByName(got)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLE_OP12 = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
d AS (SELECT r, doc_id, CAST(len(terms) AS BIGINT) AS n FROM t WHERE len(terms) > 0),
g AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM d),
p AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(terms) AS term FROM t) GROUP BY r, term),
i AS (SELECT DISTINCT item_id, list_sort(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS terms FROM benchmark),
k AS (SELECT row_number() OVER () AS q, item_id, terms FROM i),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, g GROUP BY term, docs),
s AS (
  SELECT k.q, k.item_id, d.doc_id, d.r, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (100 - 50 + ((50 * d.n * g.docs) // g.tokens))))) AS BIGINT) AS score
  FROM (SELECT q, item_id, unnest(terms) AS term FROM k) k JOIN p ON p.term = k.term JOIN w ON w.term = k.term JOIN d ON d.r = p.r, g
  GROUP BY k.q, k.item_id, d.doc_id, d.r),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 50
"""
