"""Models that a task loads once: a scorer of sentences and a generator, with an interpolated bigram and a Markov chain of events as what is shipped.

``loaded`` is the mechanism for any model: its worker loads the model when a task begins, puts the distinct inputs of each Arrow
batch in order of length, and hands them over in batches of a bounded number of words. An answer may depend on the row's own
inputs alone (a generator's seed is one of them), so batches and partitions never show in results.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from disfluo.functions.text import ends_clause, normalise, spoken_form, tokens
from disfluo.operators.evaluate import deleted


class Model(Protocol):
    def answers(self, inputs: list[tuple]) -> list:
        """One answer for each tuple of inputs; the first of a tuple is a text of words between single spaces."""


def in_batches(inputs: list[tuple], rows: int, words: int) -> Iterator[list[tuple]]:
    """The distinct inputs in order of length, at most so many of them and, beyond one, so many words with padding in a batch."""
    sized = sorted((t[0].count(" ") + 1 if t[0] else 0, t) for t in dict.fromkeys(inputs))
    batch: list[tuple] = []
    for n, t in sized:
        if batch and (len(batch) >= rows or (len(batch) + 1) * n > words):
            yield batch
            batch = []
        batch.append(t)
    if batch:
        yield batch


def loaded(load: Callable[[], Model], kind: str, rows: int = 256, words: int = 16_384) -> Callable[..., Column]:
    """A function from a text column and others to the column of a model's answers of the type kind; null inputs count as empty texts.

    load runs in the worker, once in a task, before the first batch.
    """

    @F.pandas_udf(kind)
    def answer(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model = load()
        for given in batches:
            inputs = list(zip(*given))
            known: dict = {}
            for batch in in_batches(inputs, rows, words):
                known.update(zip(batch, model.answers(batch)))
            yield pd.Series([known[t] for t in inputs], dtype=object)

    return lambda text, *others: answer(*[F.coalesce(c.cast("string"), F.lit("")) for c in (text, *(others or (F.lit(""),)))])


# --- an interpolated bigram of words -------------------------------------------------------------------------------------

#: What stands before a sentence's first word; no normalised word is like it.
START = "<s>"


def word_keys(text: Column) -> Column:
    return F.transform(F.split(text, " "), normalise)


def bigram_counts(sentences: DataFrame) -> DataFrame:
    """(before, word, n) of sentences (text): how often a word follows another or the start."""
    w = sentences.filter("text is not null").select(F.explode(F.array(word_keys(F.col("text")))).alias("ws"))
    pairs = w.select(F.explode(F.transform("ws", lambda x, i: F.struct(F.when(i == 0, START).otherwise(F.get("ws", i - 1)).alias("before"), x.alias("word")))).alias("p"))
    return pairs.groupBy("p.before", "p.word").agg(F.count("*").alias("n"))


class PackedBigrams:
    """Bigram counts as arrays: bits of a word given the one before it.

    The relative frequency after a context is mixed with the word's own by the context's number of followers, and that with one
    word shared evenly by all known words and an unknown one.
    """

    def __init__(self, before: list[str], word: list[str], n: np.ndarray):
        self.number = {w: k for k, w in enumerate(dict.fromkeys([START, *before, *word]))}
        v = self.size = len(self.number) + 1  # and the unknown word
        at = lambda ws: np.fromiter((self.number[w] for w in ws), np.int64, len(ws))
        first, second, n = at(before), at(word), np.asarray(n, dtype=np.int64)
        key = first * v + second
        order = np.argsort(key)
        self.key, self.n = key[order], n[order]
        self.followers, self.times, own = (np.bincount(x, weights=y, minlength=v) for x, y in ((first, None), (first, n), (second, n)))
        self.own = (own + 1.0 / (np.count_nonzero(own) + 1)) / (own.sum() + 1)

    def answers(self, inputs: list[tuple]) -> list:
        words = [t[0].split(" ") for t in inputs]
        unknown = self.size - 1
        ids = np.array([self.number.get(w, unknown) for ws in words for w in ws], dtype=np.int64)
        ends = np.cumsum([len(ws) for ws in words])
        before = np.concatenate(([0], ids[:-1]))
        before[ends[:-1]] = self.number[START]
        key = before * self.size + ids
        at = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
        seen = np.where(self.key[at] == key, self.n[at], 0) if len(self.key) else np.zeros(len(key))
        after = self.times[before] + self.followers[before]
        p = np.where(after > 0, (seen + self.followers[before] * self.own[ids]) / np.maximum(after, 1), self.own[ids])
        return np.split(-np.log2(p), ends[:-1])


#: Tokens in a chunk of sentences and keys in a bucket of facts, about, where bigrams are too many to be held by a task.
CHUNK_TOKENS, BUCKET_KEYS, LEAST_PARTS = 500_000, 400_000, 16


class Asked:
    """What the sentences of a chunk ask: each word and each pair of neighbours once, as keys (a pair is two words with a space between),
    by bucket and in order, so that answers need no keys."""

    def __init__(self, texts: list[str], buckets: int):
        words = [t.split(" ") for t in texts]
        self.ends = np.cumsum([len(ws) for ws in words])
        codes, names = pd.factorize(np.array([START, *[w for ws in words for w in ws]], dtype=object))
        self.ids = codes[1:]
        self.before = codes[:-1].copy()
        self.before[[0, *self.ends[:-1]]] = 0  # START
        pairs, self.pair = np.unique(self.before * len(names) + self.ids, return_inverse=True)
        self.names = names.tolist()
        self.keys = self.names + [f"{self.names[x]} {self.names[y]}" for x, y in zip(*(part.tolist() for part in np.divmod(pairs, len(names))))]
        self.parts: dict[int, list[int]] = {}
        for k in sorted(range(len(self.keys)), key=self.keys.__getitem__):
            self.parts.setdefault(zlib.crc32(self.keys[k].encode()) % buckets, []).append(k)

    def bits(self, answers: dict[int, np.ndarray], known: int, every: int) -> list[np.ndarray]:
        facts = np.zeros((3, len(self.keys)), dtype=np.int64)
        for bucket, at in self.parts.items():
            facts[:, at] = answers[bucket]
        n, (followers, times), own = facts[0, len(self.names) + self.pair], facts[:2, self.before], facts[2, self.ids]
        p1 = (own + 1.0 / (known + 1)) / (every + 1)
        p = np.where(times > 0, (n + followers * p1) / np.maximum(times + followers, 1), p1)
        return np.split(-np.log2(p), self.ends[:-1])


@dataclass
class Bigrams:
    """A scorer of sentences by word bigrams (see PackedBigrams); ``counts`` comes from bigram_counts.

    Up to ``most`` different bigrams travel to the workers as one broadcast, and ``loaded`` serves them; of more, chunks of
    sentences ask the buckets that the counts are dealt to for their different words and pairs, and get numbers back. Both give the
    same bits. Defined results: an empty text is one empty word; unknown words share what one word's count is worth with the known
    ones; without any counts every word has 0 bits; a null text has null bits.
    """

    counts: DataFrame
    most: int = 1_000_000
    column: Callable[..., Column] | None = field(default=None, repr=False)
    small: bool | None = field(default=None, repr=False)

    def __post_init__(self):
        self.counts = self.counts.persist()  # counted once for all that is read from it
        self.size = self.counts.count()
        self.small = self.size <= self.most
        if self.small:
            held = self.counts.toPandas()  # bounded by most
            data = self.counts.sparkSession.sparkContext.broadcast((held["before"].tolist(), held["word"].tolist(), held["n"].to_numpy()))
            self.column = loaded(lambda: PackedBigrams(*data.value), "array<double>")

    def score(self, sentences: DataFrame) -> DataFrame:
        """Sentences (text) with ``bits``, a number for each word between single spaces."""
        if self.small:
            return sentences.withColumn("bits", F.when(F.col("text").isNotNull(), self.column(F.array_join(word_keys(F.col("text")), " "))))
        return self.joined(sentences)

    def joined(self, sentences: DataFrame) -> DataFrame:
        long = lambda c: c.cast("long")
        first = self.counts.select(F.col("before").alias("key"), F.lit(1).alias("a"), F.col("n").alias("b"), F.lit(0).alias("c"))
        second = self.counts.select(F.col("word").alias("key"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.col("n").alias("c"))
        of_words = first.unionByName(second).groupBy("key").agg(*[F.sum(x).alias(x) for x in "abc"])  # followers, times as context, times as word
        of_pairs = self.counts.select(F.concat_ws(" ", "before", "word").alias("key"), long(F.col("n")).alias("a"), long(F.lit(0)).alias("b"), long(F.lit(0)).alias("c"))
        known, every = self.counts.agg(F.count_distinct("word"), F.coalesce(F.sum("n"), F.lit(0))).first()
        chunks, buckets = max(LEAST_PARTS, -(-every // CHUNK_TOKENS)), max(LEAST_PARTS, -(-self.size // BUCKET_KEYS))
        facts = of_words.unionByName(of_pairs).withColumn("bucket", F.pmod(F.crc32(F.encode("key", "utf-8")), F.lit(buckets)).cast("int"))
        whole = [F.col(f"`{c.name}`") for c in sentences.schema if "map" not in c.dataType.simpleString()]  # copies of a text spread by what else stands in the row
        cut = sentences.withColumn("_keys", F.array_join(word_keys(F.col("text")), " ")).withColumn("_chunk", F.pmod(F.xxhash64(*whole), F.lit(chunks)).cast("int"))

        def ask(rows: pa.Table) -> pa.Table:
            parts = (asked := Asked(rows["_keys"].to_pylist(), buckets)).parts
            packed = [zlib.compress(json.dumps([asked.keys[k] for k in at]).encode(), 1) for at in parts.values()]
            return pa.table({"bucket": pa.array(list(parts), pa.int32()), "chunk": pa.array([rows["_chunk"][0].as_py()] * len(parts), pa.int32()), "asked": pa.array(packed, pa.binary())})

        def answer(held: pa.Table, asks: pa.Table) -> pa.Table:
            at = {k: i for i, k in enumerate(held["key"].to_pylist(), 1)}
            numbers = np.array([[0, *held[c].to_pylist()] for c in "abc"], dtype=np.int64)
            packed = [zlib.compress(numbers[:, [at.get(k, 0) for k in json.loads(zlib.decompress(x))]].tobytes(), 1) for x in asks["asked"].to_pylist()]
            return asks.drop_columns("asked").append_column("found", pa.array(packed, pa.binary()))

        def put(rows: pa.Table, answers: pa.Table) -> pa.Table:
            keys = rows["_keys"].to_pylist()
            bits: list = [None] * len(keys)
            if given := [i for i, k in enumerate(keys) if k is not None]:
                found = {b: np.frombuffer(zlib.decompress(x), dtype=np.int64).reshape(3, -1) for b, x in zip(answers["bucket"].to_pylist(), answers["found"].to_pylist())}
                for i, own in zip(given, Asked([keys[i] for i in given], buckets).bits(found, known, every)):
                    bits[i] = own
            return rows.drop_columns(["_keys", "_chunk"]).append_column("bits", pa.array(bits, pa.list_(pa.float64())))

        asks = cut.filter("_keys is not null").select("_keys", "_chunk").groupBy("_chunk").applyInArrow(ask, "bucket int, chunk int, asked binary")
        answers = facts.groupBy("bucket").cogroup(asks.groupBy("bucket")).applyInArrow(answer, "bucket int, chunk int, found binary")
        schema = T.StructType([*sentences.schema, T.StructField("bits", T.ArrayType(T.DoubleType()))])
        return cut.groupBy("_chunk").cogroup(answers.groupBy("chunk")).applyInArrow(put, schema)


# --- a Markov chain of events --------------------------------------------------------------------------------------------

NONE, AGAIN = "none", "repetition"


def onsets(words: Column) -> Column:
    """For each word whether a clause begins with it."""
    return F.transform(words, lambda w, i: (i == 0) | F.coalesce(ends_clause(F.get(words, i - 1)), F.lit(False)))


def events_by_word(utts: DataFrame) -> DataFrame:
    """For each utterance its level and an array over the script's words: clause onset, kind of the first event before the word, its words."""

    def event(a: Column) -> Column:
        start, end = deleted(a)
        rest = F.filter(F.slice("alignment", end + 1, F.greatest(F.size("alignment") - end, F.lit(0))), lambda x: x.isNotNull())
        return F.struct(F.coalesce(F.get(rest, F.lit(0)), F.size("clean_tokens")).alias("at"), a.type.alias("kind"), F.array_join(F.slice("disfluent_tokens", start + 1, end - start), " ").alias("words"))

    known = F.filter("annotations", lambda a: a.type.isNotNull() & deleted(a)[0].isNotNull())
    u = utts.select("asked_level", "clean_tokens", F.explode(F.array(F.transform(known, event))).alias("events"), onsets(F.col("clean_tokens")).alias("onsets"))

    def at(w: Column, i: Column) -> Column:
        first = F.get(F.filter("events", lambda e: e.at == i), F.lit(0))
        return F.struct(F.get("onsets", i).alias("onset"), F.coalesce(first.kind, F.lit(NONE)).alias("kind"), first.words.alias("words"))

    return u.select("asked_level", F.transform("clean_tokens", at).alias("at"))


def cumulated(counts: list[tuple[str, int]]) -> tuple[list[str], list[int]]:
    total, upto = 0, []
    for _, n in counts:
        total += n
        upto.append(total)
    return [c for c, _ in counts], upto


def drawn(choices: tuple[list[str], list[int]] | None, digits: int) -> str | None:
    """The choice at a number of 32 bits on the scale of the choices' counts."""
    if choices is None:
        return None
    names, upto = choices
    return names[bisect_right(upto, digits * upto[-1] >> 32)]


class Chain:
    """Says scripts: before each word an event of a kind that depends on the level, the kind before the last word and the clause onset."""

    def __init__(self, steps: dict, phrases: dict):
        self.steps, self.phrases = steps, phrases

    def answers(self, inputs: list[tuple]) -> list[str]:
        return [self.say(*t) for t in inputs]

    def say(self, text: str, flags: str, level: str, seed: str) -> str:
        out, kind = [], NONE
        for i, word in enumerate(text.split(" ") if text else []):
            h = hashlib.md5(f"{seed}:{i}".encode()).digest()
            kind = drawn(self.steps.get((level, kind, flags[i])), int.from_bytes(h[:4])) or NONE
            head = word if kind == AGAIN else drawn(self.phrases.get(kind), int.from_bytes(h[4:8])) if kind != NONE else None
            out += [head, word] if head else [word]
        return " ".join(out)


def learn_chain(utts: DataFrame, phrases: int = 1000) -> Chain:
    """A chain from utterances with annotations: counts of each kind after (level, kind before the last word, onset), and the ``phrases`` most
    frequent words of each kind (equal counts by text). Only these counts come to the driver: they don't grow with the rows."""
    at = events_by_word(utts)
    said = lambda x: F.when(~x.kind.isin(NONE, AGAIN), x.words)
    step = lambda x, i: F.struct(F.when(i == 0, NONE).otherwise(F.get("at", i - 1).kind).alias("before"), x.onset.cast("int").alias("onset"), x.kind.alias("kind"), said(x).alias("words"))
    counts = at.select("asked_level", F.explode(F.transform("at", step)).alias("s")).groupBy("asked_level", "s.before", "s.onset", "s.kind", "s.words").agg(F.count("*").alias("n"))
    counts = counts.persist()  # the utterances are read once; both tables come from these counts
    steps: dict = {}
    by_step = counts.groupBy("asked_level", "before", "onset", "kind").agg(F.sum("n").alias("n"))
    for r in sorted(by_step.collect(), key=lambda r: r["kind"]):  # levels x kinds x kinds x 2 rows at most
        steps.setdefault((str(r["asked_level"]), r["before"], str(r["onset"])), []).append((r["kind"], r["n"]))
    words = counts.filter("words <> ''").groupBy("kind", "words").agg(F.sum("n").alias("n"))
    first = words.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "words"))).filter(F.col("place") <= phrases)
    found: dict = {}
    for r in sorted(first.collect(), key=lambda r: r["place"]):  # so many phrases of each kind at most
        found.setdefault(r["kind"], []).append((r["words"], r["n"]))
    counts.unpersist()
    return Chain({s: cumulated(row) for s, row in steps.items()}, {k: cumulated(row) for k, row in found.items() if row})


@dataclass
class Loaded:
    """A generator by any model that says (text, onsets as 0 and 1, level, seed): a row's seed is (seed, level, utterance), so the speech of
    a script doesn't depend on the rows beside it. An empty or null script is said as an empty text; level 0 is asked of the model, too."""

    load: Callable[[], Model]
    seed: int = 13
    rows: int = 64

    def speak(self, scripts: DataFrame) -> DataFrame:
        words = tokens(F.col("clean"))
        flags = F.array_join(F.transform(onsets(words), lambda x: x.cast("int").cast("string")), "")
        seed = F.concat_ws(":", F.lit(str(self.seed)), F.col("asked_level").cast("string"), F.col("utt_id").cast("string"))
        return scripts.withColumn("spoken", loaded(self.load, "string", self.rows)(F.array_join(F.transform(words, spoken_form), " "), flags, F.col("asked_level"), seed))


def markov(utts: DataFrame, seed: int = 13) -> Loaded:
    """The shipped generator, learned from utterances with annotations."""
    chain = learn_chain(utts)
    return Loaded(lambda: chain, seed)
