"""Removal of long byte strings that repeat across documents, by run-length indexes.

Every byte covered by a string of ``length`` bytes that also starts in a document with a smaller id is removed; strings are
judged on the input.

One index of the whole corpus would have to pass through one task, so the corpus is dealt out to many small ones. Each window
of ``length`` bytes has an anchor: its substring of ``anchor`` bytes with the least hash (leftmost of equals). Equal windows
have equal anchors, so windows can be dealt out by their anchor's hash. Consecutive windows with one anchor make a segment,
and segments are the unit that is sent:

1. each text block sends its distinct segments as fingerprints of anchor and segment, with the least id that holds them;
   hash buckets answer whether a segment also stands in a document with a smaller id (all its windows are matched), or
   whether its anchor occurs in another segment (its windows may be matched in part);
2. only the latter send their bytes; each bucket builds the run-compressed Burrows-Wheeler transform of its segments (of
   those that share a window's hash with another id at all), with samples at the runs' ends and the least id of what each
   run's suffixes begin with, and streams the segments through it: where the match is ``length`` bytes long, the run says
   whether a smaller id holds it;
3. each block marks its documents with both answers.

Runs of equal segments are merged before they are sent, so what is sent for a string that stands in a third of all
documents is one entry for each block. An anchor that stands in very many different segments (a phrase shorter than a window,
between other words each time) would fill one bucket: such anchors are looked for in a part of the blocks, and windows with
them are sent one by one, as fingerprints dealt out by the whole window, with the least id of each. Which way a window goes
makes no difference to the result.

Fingerprints have 72 bits or more, beyond which results are exact.

Defined results: a null or empty text has no bytes; documents with equal ids do not count against each other, so repeated
rows are treated alike; null ids count as greater than any other. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from disfluo.llm.common import Block, blocks_of, buckets_for, mix64, read, stable, stretches, text_blocks, unpacked

M = 0x9E3779B97F4A7C15
M_INVERSE = pow(M, -1, 1 << 64)
LAST_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Repeat:
    """length: bytes of a string that counts; anchor: bytes by which windows are dealt out; probe, least_probe: share and
    least number of blocks in which crowded anchors are looked for; crowd: different segments there that make one (more
    if a millionth of all segments there is more); span: bytes that are cut into segments at once."""

    length: int = 50
    anchor: int = 20
    probe: float = 1 / 32
    least_probe: int = 64
    crowd: int = 64
    span: int = 1 << 18


def _power(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, dtype=np.uint64)
    if n:
        factors[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(factors, dtype=np.uint64)


def rolling(body: np.ndarray, width: int) -> np.ndarray:
    """A hash of each substring of ``width`` bytes, by doubling."""
    with np.errstate(over="ignore"):
        have, size = body.astype(np.uint64) + np.uint64(1), 1
        out, done = None, 0
        while True:
            if width & size:
                part = have[done : len(body) - width + done + 1]
                out = part.copy() if out is None else out * np.uint64(pow(M, size, 1 << 64)) + part
                done += size
            if size * 2 > width:
                return mix64(out)
            have = have[: len(have) - size] * np.uint64(pow(M, size, 1 << 64)) + have[size:]
            size *= 2


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbouring values."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[: len(values) - size], values[size:])
        size *= 2
    return values if size == width else np.minimum(values[: len(values) - (width - size)], values[width - size :])


class Segments:
    """The segments of a block: first and last window, anchor, document, and both fingerprints."""

    def __init__(self, block: Block, cfg: Repeat):
        parts = []
        for lo, hi, starts, ends in self._portions(block, cfg):
            found = self._within(block.body[lo:hi], starts - lo, ends - lo, cfg)
            parts.append([x + lo if k < 3 else x for k, x in enumerate(found)])
        names = ("first", "last", "anchor", "key", "content")
        for k, name in enumerate(names):
            kind = np.int64 if k < 3 else np.uint64
            setattr(self, name, np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, dtype=kind))
        self.doc = np.searchsorted(block.ends, self.first, side="right")

    @staticmethod
    def _portions(block: Block, cfg: Repeat) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """A few hundred KB of documents at a time, or of one long document, which bounds the working memory: first byte, past
        the last, and where the documents in it start and end. Portions of a document overlap, so that each window is in one."""
        d = 0
        while d < len(block.lens):
            e = max(d + 1, int(np.searchsorted(block.ends, block.starts[d] + cfg.span, side="right")))
            long = np.flatnonzero(block.lens[d:e] >= cfg.length) + d
            if len(long) and block.lens[d] <= cfg.span:
                yield int(block.starts[d]), int(block.ends[e - 1]), block.starts[long], block.ends[long]
            elif len(long):
                for lo in range(int(block.starts[d]), int(block.ends[d]) - cfg.length, cfg.span):
                    hi = min(lo + cfg.span + cfg.length, int(block.ends[d]))
                    yield lo, hi, np.array([lo]), np.array([hi])
            d = e

    @staticmethod
    def _within(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, cfg: Repeat) -> list[np.ndarray]:
        """First window, last window, anchor and both fingerprints of each segment of the documents that lie at the places given."""
        n, low = len(body), np.uint64(0xFFFFFFFF)
        grams = rolling(body, cfg.anchor)
        at = (sliding_least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), cfg.length - cfg.anchor + 1) & low).astype(np.int64)
        edge = np.zeros(n + 1, dtype=np.int8)
        edge[starts] += 1
        edge[ends - cfg.length] -= 1  # past the last window; the newline after a text is no part of it
        valid = np.cumsum(edge[: len(at)]).astype(bool)
        new = np.ones(len(at), dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | ~valid[:-1]
        new[starts] = True
        stop = np.ones(len(at), dtype=bool)
        stop[:-1] = new[1:] | ~valid[1:]
        first, last = np.flatnonzero(new & valid), np.flatnonzero(stop & valid)
        anchor = at[first]
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((body.astype(np.uint64) + np.uint64(1)) * _power(M, n), dtype=np.uint64)))
            end = last + cfg.length
            whole = (sums[end] - sums[first]) * _power(M_INVERSE, n)[first]
            content = mix64(whole + ((end - first).astype(np.uint64) << np.uint64(32)) + (anchor - first).astype(np.uint64))
            key = mix64(grams[anchor] + np.uint64(0x2545F4914F6CDD1D))  # anchors have small hashes, so their own would crowd the first buckets
        return [first, last, anchor, key, content]


SECOND = 0xD1B54A32D192ED03


def window_hashes(body: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the windows that start at the places given."""
    one, two = _power(M, length), _power(SECOND, length)
    out = np.zeros((2, len(at)), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(length):
            x = body[at + k].astype(np.uint64) + np.uint64(1)
            out[0] += x * one[k]
            out[1] += x * two[k]
    return mix64(out[0]), mix64(out[1])


def crowded_anchors(blocks: DataFrame, cfg: Repeat) -> np.ndarray:
    """Sorted keys of the anchors that stand in very many different segments, found in a part of the blocks; a million at most."""
    every = max(1, int(min(1 / cfg.probe, blocks.count() / cfg.least_probe)))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block in blocks_of(batch):
                s = Segments(block, cfg)
                pairs = np.unique(np.stack([s.key, s.content], axis=1), axis=0) if len(s.key) else np.zeros((0, 2), np.uint64)
                yield pd.DataFrame({"key": pairs[:, 0].view(np.int64), "content": pairs[:, 1].view(np.int64)})

    picked = blocks.filter(F.pmod(F.xxhash64("block"), F.lit(every)) == 0) if every > 1 else blocks
    seen = picked.mapInPandas(probe, "key long, content long").distinct().groupBy("key").agg(F.count("*").alias("n"))
    seen = stable(seen.filter(F.col("n") >= cfg.crowd // 4))
    limit = max(cfg.crowd, (seen.agg(F.sum("n")).first()[0] or 0) // 1_000_000)
    return np.sort(np.array([r["key"] for r in seen.filter(F.col("n") >= limit).select("key").collect()], dtype=np.int64).view(np.uint64))


def _among(keys: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered) or not len(keys):
        return np.zeros(len(keys), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, keys), len(ordered) - 1)] == keys


class Units:
    """What a block sends: distinct (anchor, segment) pairs, kind 0, and distinct windows of crowded anchors, kind 1.

    Each kind is in the order of its fingerprints; a unit has the least id that holds it.
    """

    def __init__(self, block: Block, cfg: Repeat, bits: int, crowded: np.ndarray):
        self.segments = s = Segments(block, cfg)
        self.ids = np.where(block.null_id, LAST_ID, block.ids)
        apart = _among(s.key, crowded)
        self.plain = np.flatnonzero(~apart)
        some = np.flatnonzero(apart)
        windows = s.last[some] - s.first[some] + 1
        self.window = np.repeat(s.first[some] - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
        hashes = window_hashes(block.body, self.window, cfg.length)
        doc = np.searchsorted(block.ends, self.window, side="right")
        self.kinds = [self._distinct(s.key[self.plain], s.content[self.plain], s.doc[self.plain], bits), self._distinct(*hashes, doc, bits)]

    def _distinct(self, key: np.ndarray, content: np.ndarray, doc: np.ndarray, bits: int) -> dict[str, np.ndarray]:
        ids = self.ids[doc]
        key, content = key >> np.uint64(32 - bits), content >> np.uint64(24)  # bucket, and 32 bits below it
        order = np.lexsort((ids, content, key))  # equal ones stay in the order of their places
        k, c = key[order], content[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        lead = order[new]  # for each unit the first member of its least document
        of = np.empty(len(order), dtype=np.int64)  # unit of each member
        of[order] = np.cumsum(new) - 1
        return {"lead": lead, "bucket": (key[lead] >> np.uint64(32)).astype(np.int64), "rest": key[lead] & np.uint64(0xFFFFFFFF), "content": content[lead], "id": ids[lead], "of": of, "later": ids > ids[lead][of]}


def _ids_packed(ids: np.ndarray) -> tuple[int, int, bytes]:
    """Base, width and differences of ids, in four bytes each if they fit."""
    base = int(ids.min()) if len(ids) else 0
    wide = len(ids) and int(ids.max()) - base >= 1 << 32
    return base, 8 if wide else 4, (ids.tobytes() if wide else (ids - base).astype(np.uint32).tobytes())


def _ids_unpacked(base: int, width: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.int64) if width == 8 else np.frombuffer(data, dtype=np.uint32).astype(np.int64) + base


NONE, PARTLY, WHOLE = 0, 1, 2


def unit_states(blocks: DataFrame, cfg: Repeat, buckets: int, crowded: np.ndarray) -> DataFrame:
    """For each block, kind and bucket the states of the block's units: matched nowhere, perhaps in part, or as a whole."""
    bits = buckets.bit_length() - 1

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block in blocks_of(batch):
                rows = []
                for kind, u in enumerate(Units(block, cfg, bits, crowded).kinds):
                    for b, at in stretches(u["bucket"]):
                        base, width, ids = _ids_packed(u["id"][at])
                        c = u["content"][at]
                        rows.append((b, kind, block.block, u["rest"][at].astype(np.uint32).tobytes(), (c >> np.uint64(8)).astype(np.uint32).tobytes(), c.astype(np.uint8).tobytes(), base, width, ids))
                yield pd.DataFrame(rows, columns=["bucket", "kind", "block", "rest", "high", "low", "base", "width", "ids"])

    def answer(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bucket, kind = key
        rest = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in pdf["rest"]])
        high = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in pdf["high"]]).astype(np.uint64)
        content = (high << np.uint64(8)) | np.concatenate([np.frombuffer(x, dtype=np.uint8) for x in pdf["low"]]).astype(np.uint64)
        ids = np.concatenate([_ids_unpacked(b, w, x) for b, w, x in zip(pdf["base"], pdf["width"], pdf["ids"])])
        order = np.lexsort((content, rest))
        r, c = rest[order], content[order]
        new_anchor = np.ones(len(order), dtype=bool)
        new_anchor[1:] = r[1:] != r[:-1]
        new = new_anchor.copy()
        new[1:] |= c[1:] != c[:-1]
        group, anchor = np.cumsum(new) - 1, np.cumsum(new_anchor) - 1
        least = np.minimum.reduceat(ids[order], np.flatnonzero(new))[group]
        several = (np.bincount(anchor, weights=new)[anchor] > 1) & (kind == 0)
        state = np.empty(len(order), dtype=np.uint8)
        state[order] = np.where(ids[order] > least, WHOLE, np.where(several, PARTLY, NONE))
        parts = np.split(state, np.cumsum([len(x) // 4 for x in pdf["rest"]])[:-1])
        return pd.DataFrame({"block": pdf["block"].to_numpy(), "kind": kind, "bucket": bucket, "n": [len(p) for p in parts], "data": [pa.compress(p.tobytes(), codec="zstd", asbytes=True) for p in parts]})

    sent = blocks.mapInPandas(send, "bucket int, kind int, block long, rest binary, high binary, low binary, base long, width int, ids binary")
    return stable(sent.groupBy("bucket", "kind").applyInPandas(answer, "block long, kind int, bucket int, n int, data binary"))


def _states(replies: pd.DataFrame, kind: int) -> np.ndarray:
    own = replies[replies["kind"] == kind].sort_values("bucket")
    return np.concatenate([np.frombuffer(pa.decompress(d, decompressed_size=int(n), codec="zstd", asbytes=True), dtype=np.uint8) for d, n in zip(own["data"], own["n"])] or [np.zeros(0, dtype=np.uint8)])


class RunIndex:
    """A run-compressed Burrows-Wheeler transform of strings shorter than twice the depth (seven or more), one after another.

    Rows are the suffixes in order, each up to its string's end; of equal ones the earlier comes first. A run is a stretch of
    rows that follow the same symbol and share their first ``depth`` symbols. Kept are each run's symbol, first row, the
    places of its first and last suffix (the sampled run ends) and, for each stretch of shared beginnings, the least id of
    the strings that hold it; nothing is kept for a row within a run.
    """

    def __init__(self, data: np.ndarray, lens: np.ndarray, ids: np.ndarray, depth: int):
        ends = np.cumsum(lens + 1) - 1
        self.symbols = np.zeros(len(data) + len(lens), dtype=np.uint16)  # 0 ends a string
        inside = np.ones(len(self.symbols), dtype=bool)
        inside[ends] = False
        self.symbols[inside] = data.astype(np.uint16) + 1
        self.starts, self.lens, self.depth, self.rows = ends - lens, lens, depth, len(self.symbols)
        left = np.repeat(ends, lens + 1) - np.arange(self.rows)  # symbols before the end of the string
        rank, have = self._firsts(left), 7
        while have < depth:
            step = min(have, depth - have)
            rank, have = self._joined(rank, left, step), have + step
        order = np.argsort(self._joined(rank, left, depth), kind="stable")
        before, shared = self.symbols[order - 1], rank[order]
        other = np.ones(self.rows, dtype=bool)
        other[1:] = shared[1:] != shared[:-1]
        new = other.copy()
        new[1:] |= before[1:] != before[:-1]
        self.start = np.flatnonzero(new)
        length = np.diff(np.append(self.start, self.rows))
        self.symbol = before[self.start]
        self.first, self.last = order[self.start], order[self.start + length - 1]
        self.shared = (np.cumsum(other) - 1)[self.start]
        self.least = np.minimum.reduceat(np.repeat(ids, lens + 1)[order], np.flatnonzero(other)) if self.rows else ids
        # for backward steps: runs by symbol and place, and how many of the symbol stand before each
        by = np.argsort(self.symbol, kind="stable")
        symbol = self.symbol[by].astype(np.int64)
        self.key = symbol * (self.rows + 1) + self.start[by]
        total = np.cumsum(length[by])
        self.less = np.concatenate(([0], np.cumsum(np.bincount(self.symbols, minlength=257))))
        self.row, self.size = total - length[by], length[by]  # rows before it, of this symbol and lesser ones: the row that its first one leads to

    def _firsts(self, left: np.ndarray) -> np.ndarray:
        """Ranks of the suffixes by their first seven symbols, up to the end of the string."""
        padded = np.concatenate((self.symbols, np.zeros(7, dtype=np.uint16))).astype(np.uint64)
        out = np.zeros(self.rows, dtype=np.uint64)
        for k in range(7):
            out = (out << np.uint64(9)) | np.where(left >= k, padded[k : self.rows + k], 0)
        return np.unique(out, return_inverse=True)[1].astype(np.uint64)

    def _joined(self, rank: np.ndarray, left: np.ndarray, step: int) -> np.ndarray:
        """Ranks by as many symbols more as the ranks ``step`` places on tell."""
        other = np.zeros(self.rows, dtype=np.uint64)
        on = np.flatnonzero(left >= step)
        other[on] = rank[on + step] + np.uint64(1)
        return np.unique((rank << np.uint64(32)) | other, return_inverse=True)[1].astype(np.uint64)

    def back(self, row: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The row to which a row leads if the symbol is put before it: those with this symbol that stand before it, counted by runs."""
        at = np.searchsorted(self.key, symbol * (self.rows + 1) + row, side="right") - 1
        known = (at >= 0) & (self.key[at] >= symbol * (self.rows + 1))
        inside = np.minimum(symbol * (self.rows + 1) + row - self.key[at], self.size[at])
        return np.where(known, self.row[at] + inside, self.less[symbol])

    def stream(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Matching statistics of the strings, read from their ends: as soon as matches are ``depth`` long, for each place that
        the strings still reach, in steps: the strings, the place, and the least id that holds what starts there."""
        by = np.argsort(-self.lens, kind="stable")
        lens = self.lens[by]
        row = np.zeros(len(by), dtype=np.int64)  # the first of the match; as the strings are in the index, there always is one
        for k in range(int(lens[0]) if len(lens) else 0):
            n = int(np.searchsorted(-lens, -k, side="left"))  # strings longer than k
            own = by[:n]
            symbol = self.symbols[self.starts[own] + lens[:n] - 1 - k].astype(np.int64)
            row = self.back(row[:n], symbol)
            if k + 1 >= self.depth:
                yield own, lens[:n] - 1 - k, self.least[self.shared[np.searchsorted(self.start, row, side="right") - 1]]


def sharing(text: np.ndarray, lens: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """Which of the strings, one after another in text, have a window whose hash a string of another id has too."""
    windows = lens - length + 1
    owner = np.repeat(np.arange(len(lens)), windows)
    at = np.repeat((np.cumsum(lens) - lens) - (np.cumsum(windows) - windows), windows) + np.arange(len(owner))
    hashes = rolling(text, length)[at]
    order = np.argsort(hashes)
    first = np.flatnonzero(np.concatenate(([True], hashes[order][1:] != hashes[order][:-1])))
    held = ids[owner[order]]
    several = np.minimum.reduceat(held, first) < np.maximum.reduceat(held, first)
    return np.unique(owner[order][np.repeat(several, np.diff(np.append(first, len(order))))])


def partial_matches(blocks: DataFrame, states: DataFrame, cfg: Repeat, buckets: int, crowded: np.ndarray, finer: int = 4) -> DataFrame:
    """For each block the segments matched in part, and for each the windows that are matched, as bits.

    Buckets are ``finer`` times as many as the states', since an index takes much more memory to build than its bytes.
    """
    bits, more = buckets.bit_length() - 1, finer.bit_length() - 1

    def send(own: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for block in blocks_of(own):
            units, state = Units(block, cfg, bits, crowded), _states(replies, 0)
            u, s = units.kinds[0], units.segments
            some = np.flatnonzero(state == PARTLY)
            lead = units.plain[u["lead"][some]]
            fine = (u["bucket"][some] << more) | (u["rest"][some] >> np.uint64(32 - more)).astype(np.int64)
            for b, at in stretches(fine):
                first, end = s.first[lead[at]], s.last[lead[at]] + cfg.length
                data = b"".join(block.bytes[i:j] for i, j in zip(first.tolist(), end.tolist()))
                rows.append((b, block.block, some[at].astype(np.int32).tobytes(), (end - first).astype(np.int32).tobytes(), u["id"][some[at]].tobytes(), pa.compress(data, codec="zstd", asbytes=True)))
        return pd.DataFrame(rows, columns=["bucket", "block", "units", "lens", "ids", "data"])

    def match(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        units = [np.frombuffer(x, dtype=np.int32) for x in pdf["units"]]
        lens = [np.frombuffer(x, dtype=np.int32).astype(np.int64) for x in pdf["lens"]]
        ids = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in pdf["ids"]])
        text = np.frombuffer(b"".join(pa.decompress(d, decompressed_size=int(n.sum()), codec="zstd", asbytes=True) for d, n in zip(pdf["data"], lens)), dtype=np.uint8)
        every, mask = np.concatenate(lens), np.zeros(len(ids), dtype=np.int64)
        some = sharing(text, every, ids, cfg.length)  # the others match nothing, and nothing matches them
        chosen = np.zeros(len(ids), dtype=bool)
        chosen[some] = True
        for own, place, least in RunIndex(text[np.repeat(chosen, every)], every[some], ids[some], cfg.length).stream():
            mask[some[own]] |= np.where(least < ids[some[own]], np.int64(1) << place, 0)
        cuts = np.cumsum([len(u) for u in units])[:-1]
        rows = [(b, u[m > 0].tobytes() + m[m > 0].tobytes(), int((m > 0).sum())) for b, u, m in zip(pdf["block"], units, np.split(mask, cuts)) if (m > 0).any()]
        return pd.DataFrame([(b, 2, 0, n, d) for b, d, n in rows], columns=["block", "kind", "bucket", "n", "data"])

    sent = blocks.groupBy("block").cogroup(states.filter("kind = 0").groupBy("block")).applyInPandas(send, "bucket int, block long, units binary, lens binary, ids binary, data binary")
    return sent.groupBy("bucket").applyInPandas(match, "block long, kind int, bucket int, n int, data binary")


def _removed(block: Block, replies: pd.DataFrame, cfg: Repeat, bits: int, crowded: np.ndarray) -> np.ndarray:
    """Which bytes of a block are removed."""
    units = Units(block, cfg, bits, crowded)
    s, edge = units.segments, np.zeros(len(block.body) + 1, dtype=np.int32)

    def mark(first: np.ndarray, end: np.ndarray) -> None:
        np.add.at(edge, first, 1)
        np.add.at(edge, end, -1)

    if len(units.plain):
        u, state = units.kinds[0], _states(replies, 0)
        whole = u["later"] | (state[u["of"]] == WHOLE)
        mark(s.first[units.plain[whole]], s.last[units.plain[whole]] + cfg.length)
        mask = np.zeros(len(state), dtype=np.int64)
        for row in replies[replies["kind"] == 2].itertuples():
            at = np.frombuffer(row.data, dtype=np.int32, count=row.n)
            mask[at] = np.frombuffer(row.data, dtype=np.int64, offset=4 * row.n)
        some = np.flatnonzero((mask[u["of"]] > 0) & ~whole)
        for k in range(cfg.length - cfg.anchor + 1):
            at = s.first[units.plain[some[(mask[u["of"][some]] >> k) & 1 > 0]]] + k
            mark(at, at + cfg.length)
    if len(units.window):
        u = units.kinds[1]
        at = units.window[u["later"] | (_states(replies, 1)[u["of"]] == WHOLE)]
        mark(at, at + cfg.length)
    return np.cumsum(edge[:-1]) > 0


def _judged(blocks: DataFrame, cfg: Repeat) -> tuple[DataFrame, Callable[[Block, pd.DataFrame], np.ndarray]]:
    """Answers to the blocks, and the function that tells from a block and its answers which bytes go."""
    buckets = buckets_for(blocks, 4 << 20)
    bits, crowded = buckets.bit_length() - 1, crowded_anchors(blocks, cfg)
    states = unit_states(blocks, cfg, buckets, crowded)
    replies = states.unionByName(partial_matches(blocks, states, cfg, buckets, crowded))
    return replies, lambda block, answers: _removed(block, answers, cfg, bits, crowded)


def digests(docs: DataFrame, cfg: Repeat = Repeat()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes that stay."""
    blocks = text_blocks(docs, 1 << 20)
    replies, removed = _judged(blocks, cfg)

    def finish(block: Block, gone: np.ndarray) -> pd.DataFrame:
        before = np.concatenate(([0], np.cumsum(gone)))
        starts = np.concatenate(([0], np.cumsum(gone & ~np.concatenate(([False], gone[:-1])))))
        ends = block.ends - 1
        digest = [hashlib.sha256(block.bytes[i:j] if before[i] == before[j] else block.body[i:j][~gone[i:j]].tobytes()).hexdigest() for i, j in zip(block.starts.tolist(), ends.tolist())]
        return block.frame(n_bytes=block.lens, n_removed=before[ends] - before[block.starts], n_spans=starts[ends] - starts[block.starts], kept_sha256=digest)

    def mark(own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([finish(block, removed(block, answers)) for block in blocks_of(own)])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(mark, schema)


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))


def remove_repeats(spark, docs: DataFrame, sf_dir: str, cfg: Repeat = Repeat()) -> DataFrame:
    """Pipeline stage: texts without their repeated strings (n_chars, where the table has it, follows), all other columns,
    whatever their names and types, as they are.

    A cut inside a character drops the rest of that character. A row of whose text no word is left goes. Null and empty texts
    stay as they are; rows that share an id, repeated rows among them, don't count against each other; null ids count as
    greater than any other; an empty table gives an empty table.
    """
    blocks = text_blocks(docs, 1 << 20, whole=True)
    replies, removed = _judged(blocks, cfg)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    n_chars = f"x{others.index('n_chars')}" if "n_chars" in others else None

    def cut(block: Block, answers: pd.DataFrame) -> pa.Table:
        gone, texts, hits = removed(block, answers), block.texts(), []
        for d, (i, j) in enumerate(zip(block.starts.tolist(), (block.ends - 1).tolist())):
            if gone[i:j].any():
                texts[d] = block.body[i:j][~gone[i:j]].tobytes().decode("utf-8", "ignore").encode()
                hits.append(d)
        out = block.table(texts)
        if n_chars and hits:
            kind, sizes = out.schema.field(n_chars).type, out[n_chars].to_pylist()
            for d in hits:
                sizes[d] = len(texts[d].decode())
            out = out.set_column(out.column_names.index(n_chars), n_chars, pa.array(sizes).cast(kind))
        empty = {d for d in hits if not texts[d].split()}
        return out.filter(pa.array([d not in empty for d in range(len(texts))], type=pa.bool_()))

    return unpacked(docs, blocks, replies, cut)
