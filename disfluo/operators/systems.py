"""What can speak, clean or score: anything with the one method that is asked of it, applied to a DataFrame."""

from __future__ import annotations

import os
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disfluo.functions.text import normalise, spoken_text
from disfluo.operators import evaluate, inject


class Generator(Protocol):
    def speak(self, scripts: DataFrame) -> DataFrame:
        """scripts (utt_id, clean, asked_level) with a column ``spoken``."""


class Cleaner(Protocol):
    def clean(self, rows: DataFrame) -> DataFrame:
        """rows with a column ``recovered``."""


class Scorer(Protocol):
    def bits(self, words: DataFrame, key: str) -> DataFrame:
        """words with a column ``bits``, the surprisal of the word in column key."""


class Rules:
    """The rule injector as a generator; level 0 is the spoken text itself."""

    def __init__(self, dial: dict[int, inject.Rates], seed: int = 13):
        self.dial, self.seed = dial, seed

    def speak(self, scripts: DataFrame) -> DataFrame:
        out = inject.spoken_by_rules(scripts, self.dial, self.seed)
        said: Column = F.array_join("disfluent_tokens", " ")
        return out.withColumn("spoken", F.when(F.col("asked_level") == 0, spoken_text(F.col("clean"))).otherwise(said))


class ByAnnotations:
    """The cleaner that undoes annotations; it needs the alignment."""

    def clean(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("recovered", evaluate.without_disfluencies())


class Unigrams:
    """Surprisal by relative frequency alone."""

    def __init__(self, words: DataFrame):
        self.words = words

    def bits(self, words: DataFrame, key: str) -> DataFrame:
        out = evaluate.with_frequency(words.withColumn("_key", normalise(F.col(key))), self.words, "_key")
        return out.withColumn("bits", -F.col("log_freq") * F.log2(F.lit(10.0))).drop("_key", "log_freq")


def looks_local(path: str) -> bool:
    """Whether a path means a folder here rather than a name to be fetched."""
    return path.startswith((".", "/", "~")) or path.split("/")[0] in ("outputs", "data", "checkpoints")


def resolve(which: str, dial: dict[int, inject.Rates], seed: int = 13, path: str = "outputs/model", load: Callable[[str], Generator] | None = None) -> Generator:
    """The generator of a name: "rules", or "model", which ``load`` makes from a path. No model is shipped."""
    if which == "rules":
        return Rules(dial, seed)
    if which != "model":
        raise ValueError(f"no generator named {which!r}: it is 'rules' or 'model'")
    if looks_local(path) and not os.path.exists(os.path.expanduser(path)):
        raise FileNotFoundError(f"no model at {path}: train one there, give another path, or speak by the rules")
    if load is None:
        raise ValueError("pass load, a function from a path to an object with a speak() method")
    return load(path)
