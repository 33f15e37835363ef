"""Helpers that several operators share: reliable checkpoints, hash splits, and a table of packed text blocks."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that separate words in every operator here (the bytes that bytes.split() splits on).
WORD = r"[^\x20\x09-\x0D]+"

#: Rows, and bytes, in an Arrow batch that goes to a Python worker; texts may be long, so batches are short.
ARROW_ROWS, ARROW_BYTES = 1000, 32 << 20

BLOCK_COLUMNS = ["block", "ids", "nulls", "lens", "body", "extra"]
BLOCK_SCHEMA = "block long, ids binary, nulls binary, lens binary, body binary, extra binary"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def short_batches(df: DataFrame) -> DataFrame:
    """df, with Arrow batches of its session at ARROW_ROWS rows and about ARROW_BYTES at most, so that a worker never holds more texts at once.

    The setting is read when a plan runs, so it stays; it bounds batches and changes no result of any query.
    """
    conf = df.sparkSession.conf
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= ARROW_ROWS:
        conf.set(name, str(ARROW_ROWS))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = conf.get(name).lower().removesuffix("b")
    if not held.isdigit() or int(held) > ARROW_BYTES:
        conf.set(name, str(ARROW_BYTES))
    return df


def stable(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder that the cluster names, so that a lost executor costs no recomputation.

    A temporary folder serves only where none is set and the whole of Spark runs in this process.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if where is None and not sc.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def id_text(name: str) -> Column:
    """An integer id as text: a column of numbers with a null in it would reach pandas as floats."""
    return F.col(name).cast("long").cast("string").alias(name)


def whole_numbers(ids) -> pd.Series:
    """Ids that came as text, as integers and nulls."""
    return pd.Series([int(x) if isinstance(x, str) else pd.NA for x in ids], dtype="Int64")


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo a number; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer on uint64 with good avalanche."""
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def stretches(ordered: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each value of a sorted array of integers, and where it stands; the work is in proportion to the array, however large its values are."""
    if len(ordered):
        starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        for value, a, b in zip(ordered[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(ordered)]):
            yield value, slice(a, b)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS))
        factors = np.full(size, 0x9E3779B97F4A7C15, dtype=np.uint64)
        factors[0] = 1
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(factors, dtype=np.uint64)
    return _POWERS[:n]


def word_hashes(body: np.ndarray, outside: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a byte array, and their first and past-the-end positions; outside: the bytes between words."""
    inside = np.concatenate(([False], ~outside[body], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start, end
    lengths = end - start
    chars = body[inside[1:-1]].astype(np.uint64) + np.uint64(1)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    power = _powers(int(lengths.max()))[np.arange(len(chars)) - np.repeat(first, lengths)]
    with np.errstate(over="ignore"):
        return mix64(np.add.reduceat(chars * power, first) + lengths.astype(np.uint64)), start, end


def pieces_of(body: np.ndarray, size: int = 1 << 20, outside: np.ndarray = _SPACE) -> Iterator[tuple[int, np.ndarray]]:
    """A byte array in pieces of about size that cut no word, each with its start, so that hashing needs memory for one at a time."""
    a = 0
    while a < len(body):
        b = min(a + size, len(body))
        while b < len(body) and not outside[body[b - 1]]:
            gap = np.flatnonzero(outside[body[b : b + 4096]])
            b = b + int(gap[0]) + 1 if len(gap) else min(b + 4096, len(body))
        yield a, body[a:b]
        a = b


ROW_BITS = 21  # a row's number is its block's, and its place there in so many bits


class Block:
    """A few MB of documents: ids, which of them are null, lengths, the bytes of all texts with one newline after each, and
    the rows' other columns, if they were asked for."""

    def __init__(self, block: int, ids: bytes, nulls: bytes, lens: bytes, body: bytes, extra: bytes):
        self.block = int(block)
        self.ids = np.frombuffer(ids, dtype=np.int64)
        self.null_id = np.frombuffer(nulls, dtype=bool)
        self.lens = np.frombuffer(lens, dtype=np.int64)
        self.ends = np.cumsum(self.lens + 1)
        self.starts = self.ends - self.lens - 1
        self.bytes = pa.decompress(body, decompressed_size=int(self.ends[-1]), codec="zstd", asbytes=True)
        self.body = np.frombuffer(self.bytes, dtype=np.uint8)
        self.rows = (self.block << ROW_BITS) + np.arange(len(self.ids), dtype=np.int64)
        self.extra = pa.ipc.open_stream(extra).read_all() if extra else None

    def frame(self, **columns) -> pd.DataFrame:
        ids = pd.array(self.ids, dtype="Int64")
        ids[self.null_id] = pd.NA
        return pd.DataFrame({"doc_id": ids} | columns)

    def texts(self) -> list[bytes]:
        return [self.bytes[i : j - 1] for i, j in zip(self.starts.tolist(), self.ends.tolist())]

    def table(self, texts: list[bytes]) -> pa.Table:
        """The rows with other texts (null where a text was null): id, text and the columns asked for."""
        null = self.extra["null_text"].to_pylist()
        own = {"id": pa.array(self.ids, mask=self.null_id), "text": pa.array([None if n else t for n, t in zip(null, texts)], type=pa.binary())}
        return pa.table(own | {c: self.extra[c] for c in self.extra.column_names if c != "null_text"})


def squeezed(data: bytes) -> bytes:
    """Text compressed harder than by default: it is written once, and shuffled more often."""
    return pa.Codec("zstd", compression_level=6).compress(data, asbytes=True)


def _packed(block: int, rows: pa.Table, names: list[str]) -> tuple:
    ids = rows["id"].combine_chunks()
    null = ids.is_null().to_numpy(zero_copy_only=False)
    texts = [t or b"" for t in rows["text"].to_pylist()]
    lens = np.array([len(t) for t in texts], dtype=np.int64)
    others = b""
    if names:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.select(names).schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(rows.select(names))
        others = sink.getvalue().to_pybytes()
    return block, ids.fill_null(0).to_numpy().tobytes(), null.tobytes(), lens.tobytes(), squeezed(b"\n".join([*texts, b""])), others


def text_blocks(docs: DataFrame, block_bytes: int = 2 << 20, whole: bool = False) -> DataFrame:
    """Documents packed into rows of about block_bytes of text, compressed, in a checkpoint; if whole, with all their columns.

    A null text becomes an empty one. A text longer than a block makes a block of its own. Because the table is written
    once, a block's number and a row's place in it always stand for the same row, whatever the ids are.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    text = F.col("text").cast("string").cast("binary")
    extra = [text.isNull().alias("null_text"), *[F.col(f"`{c}`").alias(f"x{k}") for k, c in enumerate(others)]] if whole else []
    names = ["null_text", *[f"x{k}" for k in range(len(others))]] if whole else []
    schema = pa.schema([(c, pa.int64() if c == "block" else pa.binary()) for c in BLOCK_COLUMNS])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, held, size = TaskContext.get().partitionId() << 20, [], 0

        def packed() -> pa.RecordBatch:
            row = _packed(n, pa.Table.from_batches(held).combine_chunks(), names)
            return pa.RecordBatch.from_pylist([dict(zip(BLOCK_COLUMNS, row))], schema=schema)

        for batch in batches:
            start = 0
            for at, length in enumerate(batch.column("size").to_pylist()):
                size += length + 24
                if size >= block_bytes:
                    held.append(batch.slice(start, at + 1 - start))
                    yield packed()
                    n, held, size, start = n + 1, [], 0, at + 1
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield packed()

    narrow = short_batches(docs).select(F.col("doc_id").cast("long").alias("id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).alias("size"), *extra)
    return stable(narrow.mapInArrow(pack, BLOCK_SCHEMA))


def blocks_of(pdf: pd.DataFrame) -> Iterator[Block]:
    for row in pdf[BLOCK_COLUMNS].itertuples(index=False):
        yield Block(*row)


def block_of(row: Column) -> Column:
    return F.shiftright(row, ROW_BITS)


def unpacked(docs: DataFrame, blocks: DataFrame, answers: DataFrame, edit: Callable[[Block, pd.DataFrame], pa.Table], added: T.StructField | None = None) -> DataFrame:
    """docs' rows from their blocks (packed whole), with exact types: edit makes a block's table from it and its answers (rows
    with a column ``block``); added is a column that it puts at the end."""
    kinds = {f.name: f.dataType for f in docs.schema}
    place = {"doc_id": "id", "text": "text"} | {c: f"x{k}" for k, c in enumerate(c for c in docs.columns if c not in ("doc_id", "text"))}
    fields = [T.StructField("id", T.LongType()), T.StructField("text", T.BinaryType()), *[T.StructField(x, kinds[c]) for c, x in place.items() if c not in ("doc_id", "text")]]

    def emit(own: pa.Table, got: pa.Table) -> pa.Table:
        replies = got.to_pandas()
        return pa.concat_tables([edit(Block(*row.values()), replies) for row in own.select(BLOCK_COLUMNS).to_pylist()])

    out = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(emit, T.StructType([*fields, *([added] if added else [])]))
    return out.select(*[F.col(place[c]).cast(kinds[c]).alias(c) for c in docs.columns], *([F.col(f"`{added.name}`")] if added else []))


def buckets_for(blocks: DataFrame, bytes_each: int, least: int = 16) -> int:
    """A power of two of hash buckets, as many as the text needs for about bytes_each of text in each."""
    stat = blocks.agg(F.sum(F.octet_length("body")).alias("b")).first()["b"] or 0
    n = least
    while n * bytes_each < 2.5 * stat:
        n *= 2
    return n
