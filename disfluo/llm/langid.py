"""Language identification by nearest centroid.

Texts become normalised TF-IDF vectors of character 1- to 3-grams (hashed to a fixed number of dimensions). Each
language has several centroids, found by spherical k-means. A text takes the language of the centroid with the greatest
cosine; a text further away than nearly all training texts of that language is marked as rejected.

Defined results: a null text or one without a letter is ``und`` with score 0; so is every text if there is nothing to
learn from; ties go to the first language in code-point order; repeated rows are judged alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from disfluo.llm.common import id_text, mix64, read, remainder, short_batches, whole_numbers
from disfluo.llm.sampling import chosen, key_of


@dataclass(frozen=True)
class Fit:
    """bound, total, bound_chars: training texts of each language and of all together at most, and characters of each language, drawn by a hash of id and text (the documented
    sample; rows alike count once; of more languages than ``total`` the most frequent are learned); rejected: share of the training texts that the
    rejection distance leaves out."""

    dims: int = 4096
    bound: int = 600
    total: int = 4000
    bound_chars: int = 60_000_000
    centroids: int = 3
    rounds: int = 8
    rejected: float = 0.005
    seed: str = "langid"


@dataclass
class Model:
    cfg: Fit = field(default_factory=Fit)
    idf: np.ndarray | None = None
    langs: list[str] = field(default_factory=list)
    centroids: np.ndarray | None = None
    owner: np.ndarray | None = None
    reach: np.ndarray | None = None

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine and whether the distance rejects it."""
        counts = ngram_counts(text, self.cfg.dims)
        if counts is None or not self.langs:
            return "und", 0.0, True
        cosine = self.centroids @ normalised(counts, self.idf)
        k = int(cosine.argmax())
        best = float(min(1.0, max(0.0, cosine[k])))
        return self.langs[self.owner[k]], best, best < self.reach[self.owner[k]]


_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([chr(c).isalpha() for c in range(0x30000)], dtype=bool)
    return _LETTER


def ngram_counts(text: str | None, dims: int) -> np.ndarray | None:
    """Hashed counts of the 1- to 3-grams of letters, runs of other characters counting as one space; None without a letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = _letters()[np.minimum(points, 0x2FFFF)]
    if not letter.any():
        return None
    keep = letter | np.concatenate(([False], letter[:-1]))
    chars = np.concatenate(([32], np.where(letter, points, 32)[keep], [32])).astype(np.uint64)
    out = np.zeros(dims)
    key = np.zeros(len(chars), dtype=np.uint64)
    for n in range(3):
        key = key[: len(chars) - n] * np.uint64(0x110000 + 1) + chars[n:]
        out += np.bincount((mix64(key + np.uint64(n)) % np.uint64(dims)).astype(np.int64), minlength=dims)
    return out


def normalised(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    norm = np.linalg.norm(v)
    return v / norm if norm else v


def spherical_kmeans(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """k or fewer unit centroids; the start is the text nearest the mean, then always the text worst covered so far."""
    k = min(k, len(x))
    start = [int((x @ x.mean(axis=0)).argmax())]
    while len(start) < k:
        start.append(int((x @ x[start].T).max(axis=1).argmin()))
    c = x[start]
    for _ in range(rounds):
        nearest = (x @ c.T).argmax(axis=1)
        c = np.array([x[nearest == j].mean(axis=0) if (nearest == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(docs: DataFrame, cfg: Fit = Fit()) -> Model:
    """Learn from the bounded sample; only its vectors come to the driver."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").alias("kind"), F.col("text").cast("string").alias("text"), key_of(F.col("doc_id"), F.col("text"), cfg.seed).alias("key"))
    langs = [r["kind"] for r in known.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind").limit(cfg.total).collect()]
    if not langs:
        return Model(cfg)
    bound = max(1, min(cfg.bound, cfg.total // len(langs)))
    drawn, _ = chosen(known.filter(F.col("kind").isin(langs)).select("kind", "key", F.length("text").alias("chars")), bound, cfg.bound_chars)
    # at most ``total`` keys, so broadcasting them is bounded
    rows = known.join(F.broadcast(drawn), ["kind", "key"]).groupBy("kind", "key").agg(F.first("text").alias("text")).select(F.col("kind").alias("lang"), F.col("key").alias("id"), "text")

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(lang, i, c.astype(np.float32)) for lang, i, t in zip(batch["lang"], batch["id"], batch["text"]) if (c := ngram_counts(t, cfg.dims)) is not None]
            for k in range(0, len(out), 100):
                part = out[k : k + 100]
                yield pd.DataFrame({"lang": [p[0] for p in part], "id": [p[1] for p in part], "v": [p[2].tobytes() for p in part]})

    got = short_batches(rows).mapInPandas(vectors, "lang string, id string, v binary").toPandas().sort_values(["lang", "id", "v"], kind="stable")
    if not len(got):
        return Model(cfg)
    x = np.stack([np.frombuffer(v, dtype=np.float32) for v in got["v"]]).astype(np.float64)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 0.1
    x = np.log1p(x) * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    langs = sorted(set(got["lang"]))
    code = got["lang"].map({k: n for n, k in enumerate(langs)}).to_numpy()
    parts = [spherical_kmeans(x[code == k], cfg.centroids, cfg.rounds) for k in range(len(langs))]
    reach = np.array([np.quantile((x[code == k] @ parts[k].T).max(axis=1), cfg.rejected) for k in range(len(langs))])
    return Model(cfg, idf, langs, np.concatenate(parts), np.repeat(np.arange(len(langs)), [len(p) for p in parts]), reach)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [model.predict(t if isinstance(t, str) else None) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": whole_numbers(batch["doc_id"]), "lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "rejected": [bool(g[2]) for g in got]})

    narrow = short_batches(docs).select(id_text("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInPandas(judge, "doc_id long, lang_pred string, score double, rejected boolean")


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = predict(docs, fit(docs.filter(remainder("doc_id", 4) != 2)))
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
