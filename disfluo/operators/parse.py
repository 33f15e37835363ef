"""Annotated transcripts to utterances: a parser of nested repair and group markup."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from disfluo.functions import lexicon as L
from disfluo.functions.text import is_complete, pre_clean, tidy
from disfluo.operators.detect import _NOTE, first_place

PARSED = T.StructType([T.StructField("disfluent_tokens", T.ArrayType(T.StringType())), T.StructField("clean_tokens", T.ArrayType(T.StringType())), T.StructField("alignment", T.ArrayType(T.IntegerType())), T.StructField("annotations", T.ArrayType(_NOTE))])
_PIECE = re.compile(r"\{[A-Z]|[{}\[\]+]|[^\s\[\]{}+]+")
_WORD = re.compile(r"[A-Za-z0-9',.?!;:$%&/-]+")
_NO_QUOTES = str.maketrans("", "", L.QUOTES)


class _Repair:
    """A bracket: the places of its words before the plus, after it, and of editing terms in between."""

    def __init__(self):
        self.parts = {"reparandum": [], "interregnum": [], "repair": []}
        self.corrected = False

    def take(self, place: int, grouped: bool) -> None:
        self.parts["reparandum" if not self.corrected else "interregnum" if grouped else "repair"].append(place)

    def annotation(self, words: list[str]) -> dict | None:
        spans = {k: {"start": min(p), "end": max(p) + 1} if p else None for k, p in self.parts.items()}
        if spans["reparandum"] is None:
            return None
        text = lambda s: words[s["start"] : s["end"]]
        if spans["repair"] is None:
            kind = "false_start"
        else:
            kind = "repetition" if text(spans["reparandum"]) == text(spans["repair"]) else "repair"
        return {"type": kind} | spans


def parse(body: str | None) -> dict | None:
    """An utterance from a body without its final slash; None if brackets cross or stay open, or nothing is left."""
    words, kept, alignment, open_, groups, closed = [], [], [], [], [], []
    for piece in _PIECE.findall(body or ""):
        if piece == "[":
            open_.append(_Repair())
        elif piece in ("]", "+"):
            if not open_:
                return None
            if piece == "+":
                open_[-1].corrected = True
            else:
                closed.append(open_.pop())
        elif piece[0] == "{" and len(piece) == 2:
            groups.append(piece[1] in L.DROPPED_GROUPS)
        elif piece == "}":
            if not groups:
                return None
            groups.pop()
        elif piece.strip(L.EDGE) and _WORD.fullmatch(piece):
            said = piece.translate(_NO_QUOTES).strip(L.STRIP).lower()
            if not said:
                continue
            grouped = any(groups)
            for r in open_:
                r.take(len(words), grouped)
            words.append(said)
            if grouped or any(not r.corrected for r in open_):
                alignment.append(None)
            else:
                alignment.append(len(kept))
                kept.append(piece)
    if open_ or groups or not kept:
        return None
    notes = [a for r in closed if (a := r.annotation(words))]
    claimed = {i for a in notes for k in ("reparandum", "interregnum", "repair") if a[k] for i in range(a[k]["start"], a[k]["end"])}
    start = None
    for i in range(len(words) + 1):  # each run of dropped words outside the repairs is one filler
        loose = i < len(words) and alignment[i] is None and i not in claimed
        if loose and start is None:
            start = i
        elif not loose and start is not None:
            notes.append({"type": "filler", "reparandum": None, "interregnum": {"start": start, "end": i}, "repair": None})
            start = None
    return {"disfluent_tokens": words, "clean_tokens": kept, "alignment": alignment, "annotations": sorted(notes, key=first_place)}


_EMPTY = {"disfluent_tokens": None, "clean_tokens": None, "alignment": None, "annotations": None}
parse_udf = F.pandas_udf(lambda body: pd.DataFrame([parse(b) or _EMPTY for b in body], columns=list(_EMPTY)), PARSED).asNondeterministic()


def utterances(rows: DataFrame, text: str = "text", least: int = 5, most: int = 40) -> DataFrame:
    """rows with the parsed utterance and a status: unparsed, untidy, length, or kept. Incomplete units never reach Python.

    Duplicates are left to ``first_occurrence``, which needs an order.
    """
    t = F.btrim(F.col(text), F.lit(" \t\n\r"))
    body = pre_clean(F.btrim(F.rtrim(t, F.lit("/")), F.lit(" \t\n\r")))
    out = rows.withColumn("_p", parse_udf(F.when(is_complete(F.col(text)), body)))
    out = out.select(*rows.columns, *[F.col(f"_p.{c}").alias(c) for c in _EMPTY])
    out = out.withColumn("_tidy", tidy(F.col("clean_tokens")))
    status = F.when(F.col("clean_tokens").isNull(), "unparsed").when(F.size("_tidy") != F.size("clean_tokens"), "untidy").when(~F.size("_tidy").between(least, most), "length").otherwise("kept")
    return out.withColumn("status", status).withColumn("clean_tokens", F.when(F.col("status") == "kept", F.col("_tidy")).otherwise(F.col("clean_tokens"))).drop("_tidy")


def first_occurrence(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in the order given: a grouped minimum, which combines before it shuffles."""
    return rows.groupBy(key).agg(F.min(order).alias(order), F.count("*").alias("copies"))
