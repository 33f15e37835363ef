"""A quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector: its words hashed into buckets, their logarithmic counts scaled to unit length, and standardised
measures of its structure and metadata. Beside linear weights each feature has a short vector of factors, and two
features' interaction is the product of theirs. The sum over all pairs is half of (square of the sum less sum of the squares) in
each factor, so a document is scored in time that grows with its features, not with their pairs.

Defined results: a null text is scored as an empty one, which has no words; without labels of both kinds there is no model, and
every score is the share of label 1 (one half without any); rows alike count once in training, conflicting labels once each,
null labels not at all; repeated rows are scored alike; null metadata are a feature of their own; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from disfluo.llm.common import id_text, pieces_of, read, remainder, short_batches, whole_numbers, word_hashes
from disfluo.llm.sampling import labelled


@dataclass(frozen=True)
class Machine:
    """bound, bound_chars: labelled documents of each class that are trained on at most, and their characters (the documented
    sample); buckets: of hashed words, a power of two; factors: length of a feature's vector."""

    bound: int = 1500
    bound_chars: int = 60_000_000
    buckets: int = 1 << 14
    factors: int = 6
    epochs: int = 120
    rate: float = 0.1
    l2: float = 1e-4
    seed: str = "quality"


#: Measures of a text's structure and metadata, in the order in which ``structure`` gives them.
MEASURES = ("words", "word_bytes", "upper", "digits", "symbols", "marks", "beyond_ascii", "lines", "words_a_line", "repeated_words", "repeated_lines", "no_n_chars", "n_chars", "n_chars_off")

_LOWERED = np.array([c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)], dtype=np.uint8)
_LINE_END = np.array([c == 0x0A for c in range(256)])
_KINDS = {"upper": range(0x41, 0x5B), "digits": range(0x30, 0x3A), "symbols": b"#*$%&|<>@^_~={}[]\\/+", "marks": b".,;:!?'\"()-", "beyond_ascii": range(0x80, 0x100)}
_MASKS = np.array([[c in kind for c in range(256)] for kind in _KINDS.values()], dtype=np.int64)


def _hashes(body: np.ndarray, outside: np.ndarray | None = None) -> np.ndarray:
    own = {} if outside is None else {"outside": outside}
    return np.concatenate([np.zeros(0, np.uint64), *(word_hashes(_LOWERED[piece], **own)[0] for _, piece in pieces_of(body, **own))])


def _repeated(hashes: np.ndarray) -> float:
    return 1 - len(np.unique(hashes)) / len(hashes) if len(hashes) else 0.0


def features(text: bytes, n_chars: float | None, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A text's word buckets, their values, and its measures."""
    body = np.frombuffer(text, dtype=np.uint8)
    words, lines = _hashes(body), _hashes(body, _LINE_END)
    bucket, count = np.unique((words & np.uint64(buckets - 1)).astype(np.int64), return_counts=True)
    value = np.log1p(count)
    value /= max(float(np.sqrt((value * value).sum())), 1e-12)
    shares = _MASKS @ np.bincount(body, minlength=256) / max(1, len(body))
    known = n_chars is not None and n_chars == n_chars
    chars = len(body) - int((body & 0xC0 == 0x80).sum())
    n_words, n_lines = len(words), max(1, len(lines))
    measures = [np.log1p(n_words), len(body) / max(1, n_words), *np.sqrt(shares), np.log1p(n_lines), np.log1p(n_words / n_lines), _repeated(words), _repeated(lines)]
    return bucket, value, np.array([*measures, not known, np.log1p(max(0.0, n_chars)) if known else 0.0, abs(np.log1p(max(0.0, n_chars)) - np.log1p(chars)) if known else 0.0], dtype=float)


def interactions(v: np.ndarray, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of documents whose features' factors and values stand one after the other: the sum over pairs of features, and the sums of
    the factors."""
    scaled = v * x[:, None]
    sums = np.add.reduceat(scaled, first, axis=0)
    return 0.5 * (sums * sums - np.add.reduceat(scaled * scaled, first, axis=0)).sum(axis=1), sums


@dataclass
class Model:
    cfg: Machine = field(default_factory=Machine)
    base: float = 0.5
    weights: np.ndarray | None = None
    factors: np.ndarray | None = None
    bias: float = 0.0
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None

    def vector(self, bucket: np.ndarray, value: np.ndarray, measures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.clip((measures - self.mean) / self.spread, -4, 4) / 2
        return np.concatenate((bucket, self.cfg.buckets + np.arange(len(z)))), np.concatenate((value, z))

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        if self.weights is None or not rows:
            return np.full(len(rows), self.base)
        parts = [self.vector(*r) for r in rows]
        at, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        first = np.concatenate(([0], np.cumsum([len(p[0]) for p in parts])[:-1]))
        pairs, _ = interactions(self.factors[at], x, first)
        return 1 / (1 + np.exp(-np.clip(self.bias + np.add.reduceat(self.weights[at] * x, first) + pairs, -40, 40)))


def fit_machine(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, importance: np.ndarray, cfg: Machine = Machine()) -> Model:
    """Full-batch AdaGrad on the weighted log-likelihood of a bounded sample; factors start from seeded small numbers."""
    dense = np.stack([r[2] for r in rows])
    model = Model(cfg, mean=dense.mean(axis=0), spread=np.maximum(dense.std(axis=0), 1e-3))
    parts = [model.vector(*r) for r in rows]
    size = cfg.buckets + dense.shape[1]
    at, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    lens = np.array([len(p[0]) for p in parts])
    first, doc = np.concatenate(([0], np.cumsum(lens)[:-1])), np.repeat(np.arange(len(rows)), lens)
    rng = np.random.default_rng(sum(cfg.seed.encode()))
    w, v, b = np.zeros(size), rng.normal(0, 0.05, (size, cfg.factors)), 0.0
    gw, gv, gb = np.full(size, 1e-8), np.full((size, cfg.factors), 1e-8), 1e-8
    share = importance / importance.sum()
    scatter = lambda values: np.bincount(at, weights=values, minlength=size)
    for _ in range(cfg.epochs):
        own = v[at]
        pairs, sums = interactions(own, x, first)
        p = 1 / (1 + np.exp(-np.clip(b + np.add.reduceat(w[at] * x, first) + pairs, -40, 40)))
        pull = (p - labels) * share
        each = pull[doc] * x
        dw, db = scatter(each) + cfg.l2 * w, pull.sum()
        dv = np.stack([scatter(each * (sums[doc, f] - own[:, f] * x)) for f in range(cfg.factors)], axis=1) + cfg.l2 * v
        gw, gv, gb = gw + dw * dw, gv + dv * dv, gb + db * db
        w, v, b = w - cfg.rate * dw / np.sqrt(gw), v - cfg.rate * dv / np.sqrt(gv), b - cfg.rate * db / np.sqrt(gb)
    model.weights, model.factors, model.bias = w, v.astype(np.float32), float(b)
    return model


def _metadata(docs: DataFrame) -> DataFrame:
    return docs if "n_chars" in docs.columns else docs.withColumn("n_chars", F.lit(None).cast("long"))


def train(docs: DataFrame, labels: DataFrame, cfg: Machine = Machine(), column: str = "quality") -> Model:
    """Fit on the bounded sample: its features are made in Spark, and they alone come to the driver; weights restore the classes' shares."""
    rows, counts = labelled(_metadata(docs), labels, column, cfg.bound, cfg.bound_chars, cfg.seed, ("n_chars",))
    if len(counts) < 2:
        return Model(cfg, base=float(next(iter(counts), 0.5)))

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [features(t.encode(), n, cfg.buckets) for t, n in zip(batch["text"], batch["n"])]
            yield pd.DataFrame({"key": batch["key"], "label": batch["label"], "bucket": [g[0].astype(np.int32).tobytes() for g in got], "value": [g[1].astype(np.float32).tobytes() for g in got], "measures": [g[2].tobytes() for g in got]})

    narrow = short_batches(rows).select("key", "label", "text", F.col("n_chars").cast("double").alias("n"))
    got = narrow.mapInPandas(vectors, "key string, label int, bucket binary, value binary, measures binary").toPandas().sort_values(["label", "key"])
    held = got["label"].value_counts().to_dict()
    if len(held) < 2:
        return Model(cfg, base=counts.get(1, 0) / max(1, sum(counts.values())))
    sample = [(np.frombuffer(b, np.int32).astype(np.int64), np.frombuffer(v, np.float32).astype(float), np.frombuffer(m, float)) for b, v, m in zip(got["bucket"], got["value"], got["measures"])]
    return fit_machine(sample, got["label"].to_numpy(float), got["label"].map({k: counts[k] / held[k] for k in held}).to_numpy(float), cfg)


def score(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """doc_id, score and predicted (1 from the limit on) of every document."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"]
            rows = [features(t.encode() if isinstance(t, str) else b"", n, model.cfg.buckets) for t, n in zip(texts, batch["n"])] if model.weights is not None else [()] * len(texts)
            scores = model.scores(rows)
            yield pd.DataFrame({"doc_id": whole_numbers(batch["doc_id"]), "score": scores, "predicted": (scores >= limit).astype(np.int32)})

    narrow = short_batches(_metadata(docs)).select(id_text("doc_id"), F.col("text").cast("string").alias("text"), F.col("n_chars").cast("double").alias("n"))
    return narrow.mapInPandas(judge, "doc_id long, score double, predicted int")


def op11_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    out = score(docs, train(docs.filter(remainder("doc_id", 3) != 1), labels.filter(remainder("doc_id", 3) != 1)))
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
