"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A linear model over words and word beginnings scores each sentence, the noisy-or of
its sentences' scores is the document's score, and the weights are trained on document labels alone. The same sentence
scores then say where the offending sentences are.

Defined results: a null or empty text has no sentence and scores 0; without a label of each kind the model is empty and
every score is 0; repeated labels count once, conflicting ones once each; null labels are ignored; repeated rows count once
in training and are scored alike; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from disfluo.llm.common import id_text, read, remainder, short_batches, whole_numbers
from disfluo.llm.sampling import labelled

_PIECE = re.compile(r"[^\W\d_]+|[.!?\n]+")


def sentences(text: str | None) -> list[list[str]]:
    """Lower-cased words of each sentence that has any; sentences end at full stops, question and exclamation marks and line ends."""
    out: list[list[str]] = [[]]
    for piece in _PIECE.findall((text or "").lower()):
        if piece[0] in ".!?\n":
            if out[-1]:
                out.append([])
        else:
            out[-1].append(piece)
    return out if out[-1] else out[:-1]


@dataclass(frozen=True)
class Training:
    """bound, bound_chars: labelled documents of each class that are trained on at most, drawn by a hash of id and text (the
    documented sample), fewer of them where they would hold more than so many characters; min_docs, lift: a feature must
    stand in so many sampled documents, and that many times as often in toxic ones."""

    bound: int = 1500
    bound_chars: int = 60_000_000
    min_docs: int = 6
    lift: float = 4.0
    epochs: int = 150
    rate: float = 0.3
    l2: float = 1e-5
    seed: str = "toxicity"


def features(word: str) -> list[str]:
    """The word itself and its beginnings, which mark the forms of one stem."""
    return [word, *(word[:n] + "-" for n in (4, 5, 6, 7, 8) if len(word) > n)]


@dataclass
class NoisyOr:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -30.0
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def word(self, word: str) -> float:
        """Sum of the weights of a word's features; remembered for the words met lately."""
        z = self.known.get(word)
        if z is None:
            if len(self.known) > 200_000:
                self.known.clear()
            z = self.known[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return z

    def sentence_scores(self, text: str | None) -> np.ndarray:
        z = np.array([self.bias + sum(map(self.word, set(s))) for s in sentences(text)], dtype=np.float64)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def score(self, text: str | None) -> float:
        s = self.sentence_scores(text) if self.weights else np.zeros(0)
        return float(-np.expm1(np.log1p(-np.minimum(s, 1 - 1e-12)).sum()))


def fit_noisy_or(bags: list[list[list[str]]], labels: np.ndarray, importance: np.ndarray, cfg: Training = Training()) -> NoisyOr:
    """Weights by full-batch AdaGrad on the weighted log-likelihood of the noisy-or; all inputs are a bounded sample.

    Features are first screened: those no more frequent in toxic documents can't raise any sentence's score usefully.
    """
    if len(set(labels.tolist())) < 2:
        return NoisyOr()
    seen = {0: Counter(), 1: Counter()}
    for bag, label in zip(bags, labels):
        seen[int(label)].update({f for s in bag for w in s for f in features(w)})
    n1, n0 = float((labels == 1).sum()), float((labels == 0).sum())
    kept = sorted(f for f, n in seen[1].items() if n >= cfg.min_docs and n / n1 >= cfg.lift * (seen[0][f] + 0.5) / n0)
    if not kept:
        return NoisyOr()
    vocab = {f: k for k, f in enumerate(kept)}
    doc_of, sent_of, feat = [], [], []
    for d, bag in enumerate(bags):
        for s in bag:
            for w in set(s):
                for f in features(w):
                    if (k := vocab.get(f)) is not None:
                        feat.append(k)
                        sent_of.append(len(doc_of))
            doc_of.append(d)
    doc_of, sent_of, feat = np.array(doc_of), np.array(sent_of), np.array(feat)
    y, n_docs, n_sent = labels.astype(float), len(bags), len(doc_of)
    w, b = np.zeros(len(vocab)), -6.0
    gw, gb = np.full(len(vocab), 1e-8), 1e-8
    total = importance.sum()
    for _ in range(cfg.epochs):
        z = b + np.bincount(sent_of, weights=w[feat], minlength=n_sent)
        s = np.clip(1 / (1 + np.exp(-np.clip(z, -40, 40))), 1e-12, 1 - 1e-12)
        keep = np.exp(np.bincount(doc_of, weights=np.log1p(-s), minlength=n_docs))  # probability that no sentence offends
        pull = np.where(y == 1, -keep / np.maximum(1 - keep, 1e-9), 1.0) * importance / total
        dz = s * pull[doc_of]
        g, g0 = np.bincount(feat, weights=dz[sent_of], minlength=len(vocab)) + cfg.l2 * w, dz.sum()
        gw += g * g
        gb += g0 * g0
        w -= cfg.rate * g / np.sqrt(gw)
        b -= cfg.rate * g0 / np.sqrt(gb)
    return NoisyOr({k: float(w[v]) for k, v in vocab.items() if abs(w[v]) > 1e-3}, float(b))


def train(docs: DataFrame, labels: DataFrame, cfg: Training = Training()) -> NoisyOr:
    """Fit on at most ``bound`` labelled documents of each class; the classes' true shares are restored by weights."""
    rows, counts = labelled(docs, labels, "toxic", cfg.bound, cfg.bound_chars, cfg.seed)
    if len(counts) < 2:
        return NoisyOr()
    pdf = short_batches(rows).toPandas().sort_values(["label", "key"]).rename(columns={"label": "toxic"})  # at most 2 * bound rows
    got = pdf["toxic"].value_counts().to_dict()
    if len(got) < 2:
        return NoisyOr()
    importance = pdf["toxic"].map({k: counts[k] / got[k] for k in got}).to_numpy(float)
    return fit_noisy_or([sentences(t) for t in pdf["text"]], pdf["toxic"].to_numpy(), importance, cfg)


def score(docs: DataFrame, model: NoisyOr, limit: float = 0.7) -> DataFrame:
    """doc_id, text score, predicted and the offending sentences' numbers (sentences that alone reach half of the limit)."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores, where = [], []
            for text in batch["text"]:
                s = model.sentence_scores(text if isinstance(text, str) else "") if model.weights else np.zeros(0)
                scores.append(float(-np.expm1(np.log1p(-np.minimum(s, 1 - 1e-12)).sum())))
                where.append(np.flatnonzero(s >= limit / 2).tolist())
            yield pd.DataFrame({"doc_id": whole_numbers(batch["doc_id"]), "score": scores, "predicted": [int(s >= limit) for s in scores], "offending": where})

    narrow = short_batches(docs).select(id_text("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInPandas(judge, "doc_id long, score double, predicted int, offending array<int>")


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = train(docs.filter(remainder("doc_id", 3) != 1), labels.filter(remainder("doc_id", 3) != 1))
    out = score(docs, model)
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"))


def drop_toxic(spark, docs: DataFrame, sf_dir: str, limit: float = 0.7) -> DataFrame:
    """Pipeline stage: documents without those that the model rejects; the columns, whatever their names and types, stay as they are.

    A null or empty text scores 0 and stays, as does every row where there is nothing to learn from; null and repeated ids,
    repeated rows and very long texts are judged row by row on the whole text; an empty table gives an empty table.
    """
    return drop_toxic_by(docs, train(docs, read(spark, sf_dir, "labels")), limit)


def drop_toxic_by(docs: DataFrame, model: NoisyOr, limit: float = 0.7) -> DataFrame:
    """docs without the rows whose text scores at least the limit."""
    plain = docs.toDF(*[f"x{k}" for k in range(len(docs.columns))])  # whatever the names are
    plain = short_batches(plain).withColumn("judged", F.col(f"x{docs.columns.index('text')}").cast("string"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t) for t in batch.column("judged").to_pylist()]
            yield batch.filter(pa.array([s < limit for s in scores], type=pa.bool_()))

    return plain.mapInArrow(keep, plain.schema).drop("judged").toDF(*docs.columns)
