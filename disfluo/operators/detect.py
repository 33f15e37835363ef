"""Insertions recovered from a script and its spoken form alone, by aligning the two.

The pairs of an Arrow batch are aligned together, on arrays of word numbers (``align``); then only the stretches with words that
the script lacks are looked at, one by one. Everything around it is Column expressions, the assignment of found events to gold
ones included. Filter before detecting: the function is marked as not to be repeated, which holds filters back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from disfluo.functions import lexicon as L
from disfluo.functions.text import canonical_tokens, spoken_form, tokens
from disfluo.operators.align import gaps, stretches_of
from disfluo.operators.evaluate import deleted

_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_NOTE = T.StructType([T.StructField("type", T.StringType()), *[T.StructField(n, _SPAN) for n in ("reparandum", "interregnum", "repair")]])
DETECTED = T.StructType([T.StructField("alignment", T.ArrayType(T.IntegerType())), T.StructField("annotations", T.ArrayType(_NOTE)), T.StructField("dropped", T.ArrayType(T.StringType()))])

_BY_LENGTH = sorted((tuple(p.split()) for p, _ in L.FILLERS), key=len, reverse=True)
EDITING = sorted((tuple(p.split()) for p in L.INTERREGNA), key=len, reverse=True)


def edge_phrase(run: tuple, at_end: bool) -> int:
    """Length of the longest filler phrase at one end of a run, or 0."""
    for p in _BY_LENGTH:
        if run[-len(p) :] == p if at_end else run[: len(p)] == p:
            return len(p)
    return 0


def peel(run: tuple) -> tuple[list[tuple[int, int]], int, int]:
    """Filler phrases at the ends of a run (the left end first, as long as there are any) and the bounds of the core."""
    lo, hi, found = 0, len(run), []
    while lo < hi:
        if n := edge_phrase(run[lo:hi], False):
            found.append((lo, lo + n))
            lo += n
        elif n := edge_phrase(run[lo:hi], True):
            found.append((hi - n, hi))
            hi -= n
        else:
            break
    return found, lo, hi


def editing_phrase(run: tuple) -> tuple[int, int] | None:
    return next(((i, i + len(p)) for p in EDITING for i in range(len(run) - len(p) + 1) if run[i : i + len(p)] == p), None)


def core_type(out: tuple, a: int, b: int, clean_index: int) -> str:
    run, n = out[a:b], b - a
    if editing_phrase(run):
        return "repair"
    if out[b : b + n] == run or (a >= n and out[a - n : a] == run):
        return "repetition"
    if n <= L.MAX_RESTART and (a == 0 or clean_index == 0) and L.OPENER_SET.issuperset(run):
        return "false_start"
    return "repair"


def note(out: tuple, kind: str, a: int, b: int) -> dict:
    """An annotation of a detected piece; spans are clipped to the utterance except a repetition's."""
    span = lambda x, y: {"start": x, "end": y}
    if kind == "filler":
        return {"type": kind, "reparandum": None, "interregnum": span(a, b), "repair": None}
    if kind == "repetition":
        return {"type": kind, "reparandum": span(a, b), "interregnum": None, "repair": span(b, 2 * b - a)}
    wrong, edit = b - a, None
    if kind == "repair" and (found := editing_phrase(out[a:b])):
        wrong, edit = found[0], span(a + found[0], a + found[1])
    reach = 3 if kind == "false_start" else max(1, wrong)
    return {"type": kind, "reparandum": span(a, a + wrong) if wrong else None, "interregnum": edit, "repair": span(b, min(b + reach, len(out)))}


def first_place(a: dict) -> int:
    return next((a[k]["start"] for k in ("interregnum", "repair", "reparandum") if a[k]), 0)


def detect_all(clean: list[list], out: list[list]) -> list[dict]:
    """For each pair alignment, annotations in order of their boundary, and the script's words that the spoken side lacks."""
    found = []
    for script, said, alignment, stretches in zip(clean, out, *gaps(clean, out)):
        said, notes, dropped = tuple(said), [], []
        for i, i2, j, j2 in stretches:
            dropped += script[i:i2]
            if j == j2:
                continue
            fillers, lo, hi = peel(said[j:j2])
            pieces = [("filler", j + a, j + b) for a, b in fillers]
            if lo < hi:
                pieces.append((core_type(said, j + lo, j + hi, i2), j + lo, j + hi))
            notes += [note(said, *p) for p in sorted(pieces, key=lambda p: p[1])]
        found.append({"alignment": alignment, "annotations": sorted(notes, key=first_place), "dropped": dropped})
    return found


def count_all(clean: list[list], out: list[list]) -> list[tuple[int, ...]]:
    """For each pair how many annotations of each type ``detect_all`` finds, the words that they insert, and the words dropped."""
    found, at = [], {t: k for k, t in enumerate(L.TYPES)}
    inserted, lost = len(at), len(at) + 1
    for said, stretches in zip(out, stretches_of(clean, out)):
        said, row = tuple(said), [0] * (len(at) + 2)
        for i, i2, j, j2 in stretches:
            row[lost] += i2 - i
            if j == j2:
                continue
            fillers, lo, hi = peel(said[j:j2])
            row[at["filler"]] += len(fillers)
            row[inserted] += j2 - j - (hi - lo)
            if lo < hi:
                kind = core_type(said, j + lo, j + hi, i2)
                edit = editing_phrase(said[j + lo : j + hi]) if kind == "repair" else None
                row[at[kind]] += 1
                row[inserted] += edit[1] if edit else hi - lo  # what follows an editing phrase counts as said again
        found.append(tuple(row))
    return found


def detect(clean: list, out: list) -> dict:
    return detect_all([clean], [out])[0]


def word_lists(column: pa.Array) -> list[list]:
    """The lists of an Arrow column of lists of words; a null counts as an empty one."""
    words, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy())
    return [words[i:j].tolist() for i, j in zip([0, *ends[:-1].tolist()], ends.tolist())]


def _detect_rows(clean: pa.Array, out: pa.Array) -> pa.Array:
    found = detect_all(word_lists(clean), word_lists(out))
    return pa.StructArray.from_arrays([pa.array([d[f.name] for d in found], type=f.type) for f in _DETECTED], fields=list(_DETECTED))


_DETECTED = to_arrow_schema(DETECTED)
detect_udf = F.arrow_udf(_detect_rows, DETECTED).asNondeterministic()


def detected(pairs: DataFrame, clean: str = "clean", spoken: str = "spoken") -> DataFrame:
    """pairs in the corpus schema, with annotations that come from the two texts alone, and the dropped words."""
    script = canonical_tokens(F.col(clean))
    out = pairs.withColumn("clean_tokens", script).withColumn("disfluent_tokens", tokens(F.col(spoken)))
    out = out.withColumn("_d", detect_udf(F.transform("clean_tokens", spoken_form), F.col("disfluent_tokens")))
    return out.withColumn("alignment", F.col("_d.alignment")).withColumn("annotations", F.col("_d.annotations")).withColumn("dropped", F.col("_d.dropped")).drop("_d")


COUNTED = T.StructType([*[T.StructField(f"n_{t}", T.LongType()) for t in L.TYPES], T.StructField("inserted", T.LongType()), T.StructField("lost", T.LongType())])
_COUNTED = to_arrow_schema(COUNTED)


def _count_rows(clean: pa.Array, out: pa.Array) -> pa.Array:
    rows = np.array(count_all(word_lists(clean), word_lists(out)), dtype=np.int64).reshape(len(clean), len(_COUNTED))
    return pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(_COUNTED))], fields=list(_COUNTED))


count_udf = F.arrow_udf(_count_rows, COUNTED).asNondeterministic()


def counted(pairs: DataFrame, own: str = "own", spoken: str = "disfluent_tokens") -> DataFrame:
    """pairs of words (the script's in their spoken form) with n_clean, the numbers of ``measure.measure`` and lost, the words dropped: what
    ``detected`` finds, without its places."""
    out = pairs.withColumn("_c", count_udf(own, spoken))
    out = out.select(*[c for c in pairs.columns if c != "n_clean"], F.size(own).alias("n_clean"), "_c.*")
    return out.withColumn("n_events", sum((F.col(f"n_{t}") for t in L.TYPES[1:]), F.col(f"n_{L.TYPES[0]}")))


def trace(rows: DataFrame) -> DataFrame:
    """One row for each detected insertion: type, position, the clean word it stands before, and its words."""
    e = rows.select("utt_id", "clean_tokens", "disfluent_tokens", "alignment", F.posexplode("annotations").alias("k", "a"))
    start, end = deleted(F.col("a"))
    e = e.withColumn("start", start).withColumn("end", end).filter("start is not null")
    rest = F.filter(F.slice("alignment", F.col("end") + 1, F.greatest(F.size("alignment") - F.col("end"), F.lit(0))), lambda x: x.isNotNull())
    words = F.array_join(F.slice("disfluent_tokens", F.col("start") + 1, F.col("end") - F.col("start")), " ")
    return e.select("utt_id", "k", F.col("a.type").alias("type"), F.col("start").alias("position"), F.coalesce(F.get(rest, F.lit(0)), F.size("clean_tokens")).alias("before_clean_word"), words.alias("words"))


def assigned(gold: str, found: str, reach: int = 1) -> Column:
    """Pairs (gold, found) of types: found events (type, start), in order, each take the nearest unused gold event within reach, the
    first of equally near ones; what is left pairs with ``none``. A fold over the found events, whose state holds which gold ones are used."""
    state = F.struct(F.array_repeat(F.lit(False), F.size(gold)).alias("used"), F.array().cast("array<struct<gold:string,found:string>>").alias("pairs"))
    marked = lambda g, k: F.struct(g.type.alias("type"), g.start.alias("start"), k.cast("int").alias("k"))

    def step(s: Column, f: Column) -> Column:
        near = F.filter(F.transform(gold, marked), lambda g: ~F.get(s.used, g.k) & (F.abs(g.start - f.start) <= reach))
        best = F.get(F.array_sort(F.transform(near, lambda g: F.struct(F.abs(g.start - f.start).alias("d"), g.k.alias("k"), g.type.alias("type")))), F.lit(0))
        used = F.when(best.isNull(), s.used).otherwise(F.transform(s.used, lambda u, k: u | (k == best.k)))
        return F.struct(used.alias("used"), F.concat(s.pairs, F.array(F.struct(F.coalesce(best.type, F.lit("none")).alias("gold"), f.type.alias("found")))).alias("pairs"))

    def rest(s: Column) -> Column:
        free = F.filter(F.transform(gold, marked), lambda g: ~F.get(s.used, g.k))
        return F.concat(s.pairs, F.transform(free, lambda g: F.struct(g.type.alias("gold"), F.lit("none").alias("found"))))

    starts = lambda x: F.transform(x, lambda e: e.start)
    alike = (starts(gold) == starts(found)) & (F.size(F.array_distinct(starts(gold))) == F.size(gold))  # most rows: each takes the one at its own place
    own = F.zip_with(gold, found, lambda g, f: F.struct(g.type.alias("gold"), f.type.alias("found")))
    return F.when(alike, own).otherwise(F.aggregate(found, state, step, rest))


def _events(notes: str) -> Column:
    known = F.filter(notes, lambda a: a.type.isin(*L.TYPES) & (a.reparandum.isNotNull() | a.interregnum.isNotNull()))
    return F.transform(known, lambda a: F.struct(a.type.alias("type"), deleted(a)[0].alias("start")))


def confusion(gold: DataFrame, found: DataFrame) -> DataFrame:
    """gold, found, n: how often each gold type was found as which; ``none`` on either side is a miss or a false alarm."""
    both = gold.select("utt_id", _events("annotations").alias("g")).join(found.select("utt_id", _events("annotations").alias("f")), "utt_id")
    pair = both.select(F.explode(assigned("g", "f")).alias("p"))
    return pair.groupBy(F.col("p.gold").alias("gold"), F.col("p.found").alias("found")).agg(F.count("*").alias("n"))


def check(cells: DataFrame) -> DataFrame:
    """One row of recall, precision and type accuracy from the confusion's cells."""
    n, g, f = F.col("n"), F.col("gold") != "none", F.col("found") != "none"
    total = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    out = cells.agg(total(g).alias("gold"), total(f).alias("detected"), total(g & f).alias("matched"), total(g & f & (F.col("gold") == F.col("found"))).alias("right"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return out.select("gold", "detected", "matched", ratio("matched", "gold").alias("recall"), ratio("matched", "detected").alias("precision"), ratio("right", "matched").alias("type_accuracy_of_matched"), ratio("right", "gold").alias("type_accuracy_of_gold"))
