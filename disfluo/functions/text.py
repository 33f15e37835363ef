"""Text and token functions as Column expressions: they stay in the JVM and need no shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from disfluo.functions import lexicon as L


# Patterns, parts and titles that decide which sentences there are and how they read.
CLITICS = r"(?i)\s+(n't|'s|'re|'ve|'ll|'d|'m)\b"
SPACE_BEFORE = r"\s+([,.;:!?%)\]])"
SPACE_AFTER = r"([(\[$£€])\s+"
SENTENCE_END = r'([.!?])\s+([A-Z"“])'
ALLOWED = r"^[A-Za-z0-9 ,.;:!?'()%&$£€-]+$"
LOOSE_APOSTROPHE = r"(?<![A-Za-z])'|'(?![A-Za-z])"
BAD_PARTS = ("<unk>", "@-@", "@.@", "@,@", "=", "|", "http", "–", "—")
ABBREVIATIONS = ("St.", "Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Jr.", "Sr.", "No.", "vs.")
# End of the fixed values.

_KEPT = ALLOWED[2:-3]
_WORD = r"(?![,.;:!?%)']|[nN]')[" + _KEPT.replace(" ", "") + r"]++(?<![($£€])"
#: Detokenising takes quotes away and makes white space one space or none, so these are the raw sentences that it makes begin with a capital,
#: hold ALLOWED characters alone and end with a stop; those with gaps enough for five words; and those that it leaves as they are.
MAY_PASS = r"(?U)^[\s\"“”]*[A-Z][\s\"“”" + _KEPT + r"]*[.!?][\s\"“”]*\z"
FIVE_WORDS = "^(?:[{0}]*+[^{0}]){{4}}".format(_KEPT.replace(" ", ""))
DETOKENISED = rf"^{_WORD}(?: {_WORD})*+\z"
#: An ambiguous word in a usable sentence with a space before it, as has_ambiguous finds it among the sentence's words.
AMBIGUOUS_WORD = r"(?i) [.,;:!?\"'()]*(" + "|".join(L.AMBIGUOUS.split()) + r")[.,;:!?\"'()]*( |\z)"


def tokens(text: Column) -> Column:
    """Words between white space; none for an empty text."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def spoken_form(token: Column) -> Column:
    return F.lower(F.btrim(F.translate(token, L.QUOTES, ""), F.lit(L.STRIP)))


def canonical_tokens(text: Column) -> Column:
    """Tokens with an ASCII letter or digit."""
    return F.filter(tokens(text), lambda w: w.rlike("[0-9a-zA-Z]"))


def spoken_text(text: Column) -> Column:
    return F.array_join(F.filter(F.transform(canonical_tokens(text), spoken_form), lambda w: w != ""), " ")


def normalise(word: Column) -> Column:
    return F.lower(F.btrim(word, F.lit(L.STRIP)))


def is_content(word: Column) -> Column:
    w = normalise(word)
    return (F.length(w) > 3) & ~w.isin(*sorted(L.STOPWORD_SET))


def ends_clause(token: Column) -> Column:
    return F.rtrim(token, F.lit(L.AFTER_CLAUSE)).rlike("[,;:]$")


def words_only(text: Column) -> Column:
    """Lower-cased text of letters, digits, white space and apostrophes, with single spaces."""
    return F.array_join(tokens(F.lower(F.regexp_replace(text, r"(?U)[^\w\s']|_", ""))), " ")


def unigram_key(token: Column) -> Column:
    return F.lower(F.btrim(token, F.lit(L.UNIGRAM_STRIP)))


def detokenise(text: Column) -> Column:
    """Undo white-space tokenisation: quotes go, clitics and punctuation rejoin their words."""
    out = F.trim(F.regexp_replace(F.translate(text, '"“”', ""), r"(?U)\s+", " "))
    for pattern in (CLITICS, SPACE_BEFORE, SPACE_AFTER):
        out = F.regexp_replace(out, pattern, "$1")
    return F.trim(out)


def pre_clean(text: Column) -> Column:
    out = F.regexp_replace(text, r"<<[^>]*>>|<[^>]*>", " ")
    return F.array_join(tokens(F.translate(F.regexp_replace(out, r"\(\(|\)\)", " "), "#", " ")), " ")


def is_complete(text: Column) -> Column:
    """A whole slash unit: ends with a slash, no continuation mark, and brackets that balance."""
    t = F.btrim(text, F.lit(" \t\n\r"))
    count = lambda c: F.length(t) - F.length(F.translate(t, c, ""))
    return t.endswith("/") & ~t.endswith("-/") & ~t.contains("--") & (count("[") == count("]")) & (count("{") == count("}"))


def tidy(words: Column) -> Column:
    """Clean tokens made to read as a sentence: edges trimmed, a capital first, a stop last; empty if an edge vanishes."""
    kept = F.filter(words, lambda w: F.btrim(w, F.lit(L.EDGE)) != "")
    edge = F.lit(",;:- ")
    first = F.ltrim(F.element_at(kept, 1), edge)
    first = F.concat(F.upper(F.substring(first, 1, 1)), F.substr(first, F.lit(2)))
    last = lambda w: F.when(F.rtrim(w, edge).rlike("[.?!]$"), F.rtrim(w, edge)).otherwise(F.concat(F.rtrim(w, edge), F.lit(".")))
    n = F.size(kept)
    one = F.array(last(first))
    many = F.concat(F.array(first), F.slice(kept, F.lit(2), F.greatest(n - 2, F.lit(0))), F.array(last(F.element_at(kept, -1))))
    gone = (n == 0) | (F.ltrim(F.element_at(kept, 1), edge) == "") | (F.rtrim(F.element_at(kept, -1), edge) == "")
    return F.when(gone, F.array().cast("array<string>")).when(n == 1, one).otherwise(many)


def control_source(level: Column, text: Column) -> Column:
    return F.concat(F.lit("<d"), level.cast("string"), F.lit("> say aloud: "), text)


def control_level(text: Column) -> Column:
    """The level that a control token asks for, or null."""
    return F.nullif(F.regexp_extract(text, "^<d([0-3])>", 1), F.lit("")).cast("int")


def word_spans(text: Column) -> Column:
    """Start and end, in characters, of the words between single spaces."""
    pieces = F.split(text, " ")
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def take(a: Column, w: Column) -> Column:
        span = F.struct(a.at.alias("start"), (a.at + F.length(w)).alias("end"))
        return F.struct((a.at + F.length(w) + 1).alias("at"), F.when(w == "", a.spans).otherwise(F.concat(a.spans, F.array(span))).alias("spans"))

    return F.aggregate(pieces, begin, take, lambda a: a.spans)


def fold_to_words(rows: DataFrame, text: str, pieces: str, name: str = "bits") -> DataFrame:
    """rows with an array of sums, by word of the text, of the bits of pieces (start, end, bits): a piece belongs to the last
    word that starts no later than the piece's first character that is not white space; pieces of white space alone to none.

    Exploding arrays of one element keeps places from being computed anew for each word.
    """
    inner = lambda p: F.substr(text, p.start + 1, p.end - p.start)
    first = F.transform(pieces, lambda p: F.struct((p.end - F.length(F.ltrim(F.translate(inner(p), "\t\n\r\x0b\x0c", "     ")))).alias("at"), p.end.alias("end"), p.bits.alias("bits")))
    out = rows.select("*", F.explode(F.array(word_spans(F.col(text)))).alias("_spans")).select("*", F.explode(F.array(F.filter(first, lambda p: p.at < p.end))).alias("_first"))
    starts = F.transform("_spans", lambda s: s.start)
    return out.withColumn(name, _summed(starts, F.transform("_first", lambda p: p.at), F.transform("_first", lambda p: p.bits))).drop("_spans", "_first")


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of an Arrow column of lists, and the row of each."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind), np.repeat(np.arange(len(sizes)), sizes)


def _sums(starts: pa.Array, at: pa.Array, bits: pa.Array) -> pa.Array:
    first, row = _flat(starts, np.int64)
    place, own = _flat(at, np.int64)
    worth, _ = _flat(bits, np.float64)  # a null is no number, and makes its word's sum none
    far = int(max(first.max(initial=0), place.max(initial=0))) + 1
    word = np.searchsorted(row * far + first, own * far + place, side="right") - 1
    inside = np.flatnonzero((word >= 0) & (row[np.maximum(word, 0)] == own)) if len(first) else np.zeros(0, np.int64)
    sums = np.bincount(word[inside], weights=worth[inside], minlength=len(first))  # added in the order of the pieces
    ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(starts), 0).to_numpy())))
    gone = pc.or_(pc.is_null(starts), pc.is_null(at)).to_numpy(zero_copy_only=False)
    lists = [None if gone[k] else sums[ends[k] : ends[k + 1]] for k in range(len(starts))]
    out = pa.array(lists, pa.list_(pa.float64()))
    return pa.array([None if x is None else [None if y != y else y for y in x] for x in lists], pa.list_(pa.float64())) if np.isnan(sums).any() else out


#: Sums of the pieces' bits by word: a batch's pieces find their words by one search.
_summed = F.arrow_udf(_sums, T.ArrayType(T.DoubleType()))


def surprisal_bits(scores: Column, chosen: Column) -> Column:
    """Bits of surprise at the chosen place of an array of unnormalised log scores."""
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return (F.ln(total) + top - F.get(scores, chosen)) / F.ln(F.lit(2.0))


def has_ambiguous(words: Column) -> Column:
    return F.exists(words, lambda w: F.lower(F.btrim(w, F.lit(".,;:!?\"'()"))).isin(*L.AMBIGUOUS.split()))


def sentence_split(text: Column) -> Column:
    """Sentences: lines, cut after a stop where white space and a capital or an opening quote follow."""
    return F.split(F.regexp_replace(text, SENTENCE_END, "$1\n$2"), "\n")


def may_be_usable(raw: Column) -> Column:
    """The tests that a raw sentence decides alone: detokenised, it will begin with a capital, end with a stop and hold allowed characters."""
    bad = F.lit(False)
    for part in BAD_PARTS:
        bad = bad | raw.contains(part)
    return raw.rlike(FIVE_WORDS) & raw.rlike(MAY_PASS) & ~bad


def as_sentence(raw: Column) -> Column:
    """The detokenised sentence; most raw ones are so already."""
    return F.when(raw.rlike(DETOKENISED), raw).otherwise(detokenise(raw))


def is_usable(sent: Column) -> Column:
    """The other tests, of a detokenised sentence that may be usable: its words stand between single spaces, and the first begins with a capital."""
    n = F.length(sent) - F.length(F.replace(sent, F.lit(" "), F.lit(""))) + 1
    short = F.lit(False)
    for a in ABBREVIATIONS:
        short = short | sent.endswith(a)
    loose = sent.contains("'") & sent.rlike(LOOSE_APOSTROPHE)
    unworded = sent.rlike(" [^A-Za-z]") & (sent.rlike(" [^0-9a-zA-Z ]+( |$)") | (F.regexp_count(sent, F.lit(" [0-9]")) > F.floor(n / 3)))
    return n.between(5, 40) & ~short & ~loose & ~unworded


def is_ambiguous(sent: Column) -> Column:
    """Whether a usable sentence holds an ambiguous word."""
    return F.concat(F.lit(" "), sent).rlike(AMBIGUOUS_WORD)


def is_usable_sentence(raw: Column) -> Column:
    """The nine tests that a sentence of a source corpus must pass; it is detokenised once, as an array's one element."""
    return may_be_usable(raw) & F.exists(F.array(as_sentence(raw)), is_usable)
