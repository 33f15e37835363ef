"""Language-model scoring by deleted interpolation.

A bigram model over words: P(w | h) = a(h) c(h, w) / c(h) + b(h) c(w) / N + (1 - a(h) - b(h)) / (V + 1). The weights depend on
the bucket of the context's count c(h) and are learned by expectation-maximisation on deleted counts: each training token is
predicted from the counts without itself.

Counts are over all training documents. They are taken in packed form: each text block sends its distinct n-grams, as
64-bit fingerprints cut to 40 to 48 bits beyond the bucket, to hash buckets; each bucket adds them up and answers every
block with the totals, in the block's own order. The counts never pass through the driver, and an n-gram that stands in
most documents costs one entry for each block.

Tokens: words after lower-casing A-Z, then one end token for each document.

Defined results: a null or empty text is its end token alone; repeated rows count as often as they stand; with no training
document every count is 0, the uniform part is 1 and all scores are 0. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from disfluo.llm.common import Block, blocks_of, buckets_for, mix64, read, stable, stretches, text_blocks, word_hashes

END, BEGIN = np.uint64(0x9A3F1C5D77E1B24D), np.uint64(0x51B8A06E2F94C3D7)
DEPTHS = (48, 40)  # bits kept below the bucket's: of words, of pairs
CONTEXT_BUCKETS = 48


@dataclass(frozen=True)
class Interpolation:
    """rounds: of expectation-maximisation, over the deleted counts of all training tokens; block_bytes: of text in a block,
    within which equal n-grams are merged before they are sent."""

    rounds: int = 60
    block_bytes: int = 8 << 20


class Tokens:
    """Token and pair fingerprints of a block, with their documents."""

    def __init__(self, block: Block):
        words, start = self._words(block)
        doc = np.searchsorted(block.ends, start, side="right")
        per = np.bincount(doc, minlength=len(block.ids))
        self.last = np.cumsum(per + 1) - 1  # places of the end tokens
        self.first = self.last - per
        self.doc = np.repeat(np.arange(len(block.ids)), per + 1)
        self.word = np.full(len(words) + len(block.ids), END, dtype=np.uint64)
        place = np.ones(len(self.word), dtype=bool)
        place[self.last] = False
        self.word[place] = words
        before = np.concatenate(([BEGIN], self.word[:-1]))
        before[self.first] = BEGIN
        with np.errstate(over="ignore"):
            pair = mix64(before * np.uint64(0xD6E8FEB86659FD93) + self.word)
        self.kinds = [np.unique(x, return_inverse=True) for x in (self.word, pair)]

    @staticmethod
    def _words(block: Block, span: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and places of the words, by a few hundred KB of documents at a time, which bounds the working memory."""
        body, parts, d = np.frombuffer(block.bytes.lower(), dtype=np.uint8), [], 0
        while d < len(block.lens):
            e = max(d + 1, int(np.searchsorted(block.ends, block.starts[d] + span, side="right")))
            low = int(block.starts[d])
            words, start, _ = word_hashes(body[low : int(block.ends[e - 1])])
            parts.append((words, start + low))
            d = e
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts as bytes, 255 standing for a count that follows in full."""
    big = counts >= 255
    return pa.compress(np.where(big, 255, counts).astype(np.uint8).tobytes() + counts[big].astype(np.int64).tobytes(), codec="zstd", asbytes=True)


def unpack_counts(data: bytes, n: int, size: int) -> np.ndarray:
    raw = pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True)
    counts = np.frombuffer(raw, dtype=np.uint8, count=n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw, dtype=np.int64, offset=n)
    return counts


def _size(counts: np.ndarray) -> int:
    return len(counts) + 8 * int((counts >= 255).sum())


def _keys(values: np.ndarray, bits: int, depth: int) -> bytes:
    """Sorted fingerprints cut to ``depth`` bits: the lowest bytes as they are, the rest as differences, which are small."""
    cut = (values << np.uint64(bits)) >> np.uint64(64 - depth)
    width = min(depth // 8, max(1, round((depth - np.log2(len(cut))) / 8)))
    low = cut.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    high = np.diff((cut >> np.uint64(8 * width)).astype(np.int64), prepend=0)
    packed = pack_counts(high)
    return bytes([width]) + _size(high).to_bytes(8, "little") + len(packed).to_bytes(8, "little") + packed + low.tobytes()


def _unkeyed(data: bytes) -> np.ndarray:
    width, size, packed = data[0], int.from_bytes(data[1:9], "little"), int.from_bytes(data[9:17], "little")
    low = np.frombuffer(data, dtype=np.uint8, offset=17 + packed).reshape(-1, width)
    out = np.zeros((len(low), 8), dtype=np.uint8)
    out[:, :width] = low
    high = np.cumsum(unpack_counts(data[17 : 17 + packed], len(low), size)).astype(np.uint64)
    return out.view("<u8").ravel() | (high << np.uint64(8 * width))


def training_rows(block: Block, modulus: int, left_out: int) -> np.ndarray:
    """Which documents of a block are trained on: those whose crc32 of the id as text leaves another remainder."""
    return np.array([zlib.crc32(b"" if null else str(i).encode()) % modulus != left_out for i, null in zip(block.ids.tolist(), block.null_id)], dtype=bool)


def ngram_counts(blocks: DataFrame, buckets: int, modulus: int = 7, left_out: int = 2) -> DataFrame:
    """For each block, kind (0: words, 1: pairs) and bucket the training counts of the block's n-grams in order; in rows of
    block -1 the bucket's number of tokens and of distinct trained words."""
    bits = buckets.bit_length() - 1

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block in blocks_of(batch):
                tokens = Tokens(block)
                weight = training_rows(block, modulus, left_out)[tokens.doc].astype(np.float64)
                rows = []
                for kind, (values, back) in enumerate(tokens.kinds):
                    counts = np.bincount(back, weights=weight, minlength=len(values)).astype(np.int64)
                    for b, at in stretches((values >> np.uint64(64 - bits)).astype(np.int64)):
                        rows.append((b, kind, block.block, _keys(values[at], bits, DEPTHS[kind]), pack_counts(counts[at]), _size(counts[at])))
                yield pd.DataFrame(rows, columns=["bucket", "kind", "block", "keys", "counts", "size"])

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bucket, kind = key
        parts = [_unkeyed(k) for k in pdf["keys"]]
        lens = [len(p) for p in parts]
        counts = np.concatenate([unpack_counts(c, n, s) for c, n, s in zip(pdf["counts"], lens, pdf["size"])])
        values, back = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(back, weights=counts, minlength=len(values)).astype(np.int64)
        answers = np.split(total[back], np.cumsum(lens)[:-1])
        rows = [(b, kind, bucket, pack_counts(a), n, _size(a), 0) for b, a, n in zip(pdf["block"], answers, lens)]
        if kind == 0:
            rows.append((-1, kind, bucket, b"", int(total.sum()), 0, int((total > 0).sum())))
        return pd.DataFrame(rows, columns=["block", "kind", "bucket", "counts", "n", "size", "distinct"])

    sent = blocks.mapInPandas(send, "bucket int, kind int, block long, keys binary, counts binary, size long")
    return stable(sent.groupBy("bucket", "kind").applyInPandas(add, "block long, kind int, bucket int, counts binary, n long, size long, distinct long"))


def _answered(block: Block, answers: pd.DataFrame) -> tuple[Tokens, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a block with the counts of each token, its pair and its context."""
    tokens = Tokens(block)
    got = []
    for kind, (values, back) in enumerate(tokens.kinds):
        own = answers[answers["kind"] == kind].sort_values("bucket")
        got.append(np.concatenate([unpack_counts(c, n, s) for c, n, s in zip(own["counts"], own["n"], own["size"])])[back])
    word, pair = got
    context = np.concatenate(([0], word[:-1]))
    context[tokens.first] = word[tokens.last[0]]  # as many beginnings as ends
    return tokens, word, pair, context


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(context, 0) + 1.0)).astype(np.int64)


def _bits(p: np.ndarray) -> np.ndarray:
    """0 for no probability, else 1 and twice its bits, rounded."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, 1 + np.clip(np.rint(-2 * np.log2(np.where(p > 0, p, 1))), 0, 98), 0).astype(np.int64)


def learn_weights(cells: np.ndarray, uniform: float, rounds: int) -> np.ndarray:
    """Mixture weights (pair, word, uniform) by context bucket, from rows (bucket, tokens, mean pair and mean word probability)."""
    weights = np.tile([1 / 3, 1 / 3, 1 / 3], (CONTEXT_BUCKETS, 1))
    if not len(cells):
        return np.tile([0.0, 0.0, 1.0], (CONTEXT_BUCKETS, 1))
    at, n = cells[:, 0].astype(int), cells[:, 1]
    parts = np.stack([cells[:, 2], cells[:, 3], np.full(len(cells), uniform)], axis=1)
    for _ in range(rounds):
        share = weights[at] * parts
        share *= (n / share.sum(axis=1))[:, None]
        new = np.stack([np.bincount(at, weights=share[:, k], minlength=CONTEXT_BUCKETS) for k in range(3)], axis=1) + 1e-3  # no part dies out
        weights = new / new.sum(axis=1, keepdims=True)
    seen = np.bincount(at, minlength=CONTEXT_BUCKETS) > 0
    for k in np.flatnonzero(~seen):  # a bucket without tokens takes the nearest one's weights
        weights[k] = weights[np.flatnonzero(seen)[np.abs(np.flatnonzero(seen) - k).argmin()]]
    return weights


def score(docs: DataFrame, cfg: Interpolation = Interpolation(), modulus: int = 7, left_out: int = 2) -> DataFrame:
    blocks = text_blocks(docs, cfg.block_bytes)
    counts = ngram_counts(blocks, buckets_for(blocks, 8 << 20), modulus, left_out)
    stat = counts.filter("block = -1").agg(F.sum("n").alias("n"), F.sum("distinct").alias("v")).first()
    n, v = int(stat["n"] or 0), int(stat["v"] or 0)
    answers = counts.filter("block >= 0").select("block", "kind", "bucket", "counts", "n", "size")
    uniform = 1 / (v + 1)

    def cells_of(own: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        out = []
        for block in blocks_of(own):
            tokens, word, pair, context = _answered(block, replies)
            keep = training_rows(block, modulus, left_out)[tokens.doc]
            word, pair, context = word[keep] - 1, pair[keep] - 1, context[keep] - 1
            p1, p2 = word / max(1, n - 1), np.where(context > 0, pair / np.maximum(context, 1), 0.0)
            key = (_bucket(context) * 100 + _bits(p2)) * 100 + _bits(p1)
            values, back = np.unique(key, return_inverse=True)
            add = lambda x: np.bincount(back, weights=x, minlength=len(values))
            out.append(pd.DataFrame({"cell": values, "n": add(np.ones(len(key))), "p2": add(p2), "p1": add(p1)}))
        return pd.concat(out)

    cells = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(cells_of, "cell long, n double, p2 double, p1 double")
    rows = cells.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("p2").alias("p2"), F.sum("p1").alias("p1")).orderBy("cell").collect()  # at most 48 * 100 * 100 cells
    weights = learn_weights(np.array([(r["cell"] // 10000, r["n"], r["p2"] / r["n"], r["p1"] / r["n"]) for r in rows if r["n"] > 0]), uniform, cfg.rounds)

    def judge(own: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        out = []
        for block in blocks_of(own):
            tokens, word, pair, context = _answered(block, replies)
            w = weights[np.minimum(_bucket(context), CONTEXT_BUCKETS - 1)]
            p = w[:, 0] * np.where(context > 0, pair / np.maximum(context, 1), 0.0) + w[:, 1] * word / max(1, n) + w[:, 2] * uniform
            add = lambda x: np.bincount(tokens.doc, weights=x, minlength=len(block.ids))
            out.append(block.frame(
                held_out=~training_rows(block, modulus, left_out), n_tokens=add(np.ones(len(p))).astype(np.int64), n_known=add(word > 0).astype(np.int64),
                train_tokens=np.full(len(block.ids), n), base_score=add(np.log10((word + 1) / (n + v + 1))), score=add(np.log10(p)),
            ))
        return pd.concat(out) if out else pd.DataFrame(columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(judge, schema)


def op10_lm_score(spark, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))
