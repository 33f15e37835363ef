"""Quality rules: distribution divergence.

Each document's histograms are held against the reference of its language by Jensen-Shannon distance (square root of the base-2
divergence, so 0 to 1): characters (each small letter a cell of its own), the language's most common words among themselves, and common
words against all others. References are sums over all documents. A language's limits come from its own documents' distances, by
length: the median and ``spreads`` times what lies between it and the lower quartile, as junk stands at the upper end.

Defined results: a null or empty text has no words and fails the base rule; an unknown or null language is judged by the
nearest reference, with its limits; documents under ``min_words`` words are not judged on the histograms (they pass); a text without any
common word has word distance 0 and is judged on the share of such words; a share above the reference's has distance 0; with no reference
at all nothing is judged. Repeated rows are judged alike. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from disfluo.llm.common import id_text, read, short_batches, stable, whole_numbers

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Cells of the histogram of characters: letters from a to z, small letters of Latin-1 from U+00DF, and classes of the rest.
CLASSES = ("upper", "digit", "space", "punct", "symbol", "letter", "other")
LATIN = range(0xDF, 0x100)
CELLS = 26 + len(LATIN) + len(CLASSES)
DISTANCES = ("char_distance", "word_distance", "rate_distance")
MEASURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


@dataclass(frozen=True)
class Divergence:
    """held: different words that a task adds up before it hands them on; common: how many words, by their count over all
    documents, make the histograms; least: documents of a language about as long that limits need (else those of all lengths count, then
    ``fixed`` holds); least_spread: what counts as lying between quartile and median at least, by distance."""

    held: int = 200_000
    common: int = 40
    min_words: int = 50
    spreads: float = 7.0
    least_spread: tuple[float, float, float] = (0.02, 0.04, 0.02)
    least: int = 50
    fixed: tuple[float, float, float] = (0.3, 0.7, 0.3)


@dataclass(frozen=True)
class Reference:
    """A language's common words, its counts of characters by cell, and of each common word and all others."""

    words: list[bytes]
    chars: np.ndarray
    hist: np.ndarray


def base_measures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "replace").split()
    chars = len(text) - sum(map(text.count, SPACES))
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            if line in seen:
                dup += 1
            seen.add(line)
    return len(words), chars, sum(map(text.count, SYMBOLS)), dup, repeated_words(words)


def repeated_words(words: list, window: int = 5) -> int:
    """How many words stand in a window of words that occurs at least twice in the list."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    v = len(number)
    if v == len(words):
        return 0
    if v ** window < 1 << 62:
        key = np.zeros(n, dtype=np.int64)
        for k in range(window):
            key = key * v + ids[k : k + n]
    else:  # number the pairs, then pairs of what there is so far and one word more
        key = ids[:n]
        for k in range(1, window):
            key = np.unique(key * v + ids[k : k + n], return_inverse=True)[1]
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    hit = count[back] > 1
    covered = np.zeros(len(words), dtype=bool)
    for k in range(window):
        covered[k : k + n] |= hit
    return int(covered.sum())


_TABLE: np.ndarray | None = None


def cell(c: str) -> int:
    """The cell of a character below U+3000."""
    if "a" <= c <= "z":
        return ord(c) - ord("a")
    if c.islower() and ord(c) in LATIN:
        return 26 + ord(c) - LATIN.start
    kind = (
        "space" if c.isspace() else "symbol" if c in SYMBOLS else "upper" if c.isupper() else "digit" if c.isdigit() else "letter" if c.isalpha()
        else "punct" if ord(c) < 0x80 or 0x2010 <= ord(c) < 0x2060 else "other"
    )
    return 26 + len(LATIN) + CLASSES.index(kind)


def _cell_table() -> np.ndarray:
    global _TABLE
    if _TABLE is None:
        table = np.full(0x110000, CELLS - 1, dtype=np.uint8)
        table[:0x3000] = [cell(chr(c)) for c in range(0x3000)]
        _TABLE = table
    return _TABLE


def char_cells(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    return np.bincount(_cell_table()[points], minlength=CELLS).astype(np.float64)


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms, 0 to 1."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(min(1.0, max(0.0, d / 2)) ** 0.5)


def _words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").split()


def _narrow(docs: DataFrame) -> DataFrame:
    return short_batches(docs).select(id_text("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))


def references(docs: DataFrame, cfg: Divergence = Divergence()) -> dict[str, Reference]:
    """Each language's reference, from one pass over all documents (the most common words are a top-k by exact counts).

    A task adds up its words, and hands on what it has when there are ``held`` different ones; its characters are one row for each cell.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, Counter] = defaultdict(Counter)
        chars: dict[str, np.ndarray] = {}

        def spill() -> pd.DataFrame:
            rows = [(lang, False, w, n) for lang, c in counts.items() for w, n in c.items()]
            counts.clear()
            return pd.DataFrame(rows, columns=["lang", "is_cell", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                if isinstance(lang, str) and isinstance(text, str):
                    counts[lang].update(_words(text))
                    chars[lang] = chars.get(lang, 0) + char_cells(text)
            if sum(map(len, counts.values())) >= cfg.held:
                yield spill()
        if counts:
            yield spill()
        if chars:
            rows = [(lang, True, b"%d" % k, int(n)) for lang, c in chars.items() for k, n in enumerate(c) if n]
            yield pd.DataFrame(rows, columns=["lang", "is_cell", "word", "n"])

    total = _narrow(docs).mapInPandas(count, "lang string, is_cell boolean, word binary, n long").groupBy("lang", "is_cell", "word").agg(F.sum("n").alias("n"))
    total = stable(total.withColumn("slice", F.pmod(F.xxhash64("word"), F.lit(64))))
    # the best of each slice first, so that a language's words never meet in one task
    best = total.filter("not is_cell").withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(F.desc("n"), "word"))).filter(F.col("rank") <= cfg.common)
    top: dict[str, list] = defaultdict(list)
    for r in best.select("lang", "word", "n").collect():  # at most 64 * common words of each language
        top[r["lang"]].append((-r["n"], bytes(r["word"])))
    chars: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(CELLS))
    for r in total.filter("is_cell").select("lang", "word", "n").collect():  # CELLS rows for each language
        chars[r["lang"]][int(r["word"])] = r["n"]
    every = {r["lang"]: r["n"] for r in total.filter("not is_cell").groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    out = {}
    for lang, ws in sorted(top.items()):
        ws = sorted(ws)[: cfg.common]
        own = [-n for n, _ in ws]
        out[lang] = Reference([w for _, w in ws], chars[lang], np.array([*own, every[lang] - sum(own)], dtype=np.float64))
    return out


def common_words(docs: DataFrame, cfg: Divergence = Divergence()) -> dict[str, list[bytes]]:
    """The most frequent words of each language, by their counts over all documents."""
    return {lang: r.words for lang, r in references(docs, cfg).items()}


def word_histogram(words: Counter, place: dict[bytes, int]) -> np.ndarray:
    """Counts of the common words, and of all others at the end."""
    out = np.zeros(len(place) + 1)
    for w, k in place.items():
        out[k] = words.get(w, 0)
    out[-1] = words.total() - out.sum()
    return out


def rate_distance(hist: np.ndarray, ref: np.ndarray) -> float:
    """Distance of (common words, others); 0 where common words are no rarer than in the reference."""
    own, held = (np.array([h[:-1].sum(), h[-1]]) for h in (hist, ref))
    return js_distance(own, held) if own[0] * held.sum() < held[0] * own.sum() else 0.0


def measured(docs: DataFrame, refs: dict[str, Reference], cfg: Divergence = Divergence()) -> DataFrame:
    """For each document the base measures, the reference that it is held against (null if none), whether that is its own language's, and the distances."""
    place = {lang: {w: k for k, w in enumerate(r.words)} for lang, r in refs.items()}

    def distances(lang: str, own: Counter, chars: np.ndarray) -> tuple[float, float, float]:
        hist, ref = word_histogram(own, place[lang]), refs[lang]
        return js_distance(chars, ref.chars), js_distance(hist[:-1], ref.hist[:-1]), rate_distance(hist, ref.hist)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, lang in zip(batch["text"], batch["lang"]):
                text = text if isinstance(text, str) else ""
                n_words, *rest = base_measures(text)
                failed = n_words < 10 or 100 * rest[-1] > 20 * n_words
                held, found = None, (None, None, None)
                if n_words >= cfg.min_words and refs:
                    own, chars = Counter(_words(text)), char_cells(text)
                    tried = [(distances(k, own, chars), k) for k in ([lang] if lang in refs else refs)]
                    found, held = min(tried, key=lambda t: sum(t[0]))
                rows.append((n_words, *rest, failed, held, held == lang, *found))
            out = pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "held_against", "own", *DISTANCES])
            out.insert(0, "doc_id", whole_numbers(batch["doc_id"]))
            yield out.astype(dict.fromkeys(DISTANCES, "float64"))

    return _narrow(docs).mapInPandas(measure, f"{MEASURES}, held_against string, own boolean, {', '.join(f'{d} double' for d in DISTANCES)}")


def limit(counts: dict[int, np.ndarray], length: int, rule: int, cfg: Divergence) -> float | None:
    """The limit at a length (a power of two) from counts of distances, in thousandths, by length; None where there are too few."""
    for near in ([length], range(length - 1, length + 2), counts):
        n = sum((counts[k] for k in near if k in counts), np.zeros(1001))
        if n.sum() >= cfg.least:
            upto = np.cumsum(n)
            lower, middle = (int(np.searchsorted(upto, q * upto[-1])) / 1000 for q in (0.25, 0.5))
            return middle + cfg.spreads * max(middle - lower, cfg.least_spread[rule])
    return None


def limits(found: DataFrame, cfg: Divergence = Divergence()) -> list[tuple]:
    """(reference, length, limit of each distance) for each reference and each length that there is (a power of two).

    Documents of the same distances count once, so that a large group of copies doesn't make the limits."""
    each = found.filter("held_against is not null").select("held_against", "length", "own", *DISTANCES).distinct().select("held_against", "length", "own", F.posexplode(F.array(*DISTANCES)).alias("rule", "d"))
    counts = each.groupBy("held_against", "length", "rule", F.floor(F.col("d") * 1000).cast("int").alias("bin")).agg(F.count_if("own").alias("n"))
    by: dict = defaultdict(lambda: defaultdict(lambda: np.zeros(1001)))
    for r in counts.collect():  # languages x lengths x rules x 1001 rows at most, however many documents there are
        by[r["held_against"], r["rule"]][r["length"]][r["bin"]] += r["n"]
    out = []
    for ref in sorted({k for k, _ in by}):
        for length in sorted(by[ref, 0]):
            at = [limit(by[ref, k], length, k, cfg) for k in range(len(DISTANCES))]
            out.append((ref, length, *[cfg.fixed[k] if x is None else x for k, x in enumerate(at)]))
    return out


def divergences(docs: DataFrame, cfg: Divergence = Divergence()) -> DataFrame:
    """For each document the base measures, the distances (null where not judged), and the verdict. Texts are read twice: for the
    references, and for the distances, which are written before the limits are read off them."""
    found = measured(docs, references(docs, cfg), cfg)
    found = stable(found.withColumn("length", F.floor(F.log2("n_words")).cast("int")))
    names = [f"limit_{k}" for k in range(len(DISTANCES))]
    table = docs.sparkSession.createDataFrame(limits(found, cfg), f"held_against string, length int, {', '.join(f'{c} double' for c in names)}")
    out = found.join(F.broadcast(table), ["held_against", "length"], "left")  # a row for each language and length
    fits = F.lit(True)
    for d, c in zip(DISTANCES, names):
        fits = fits & (F.col(d).isNull() | (F.col(d) <= F.col(c)))
    return out.withColumn("kept", ~F.col("base_failed") & fits).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *DISTANCES, "kept")


def op8_quality_divergence(spark, sf_dir: str) -> DataFrame:
    return divergences(read(spark, sf_dir, "documents"))
