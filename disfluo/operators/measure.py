"""Event rates of annotated utterances, the percentile cuts and the level table (the dial)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from disfluo.functions import lexicon as L
from disfluo.functions.text import unigram_key


def _of(kind: str) -> Column:
    return F.size(F.filter("annotations", lambda a: a.type == kind)).cast("long").alias(f"n_{kind}")


def span_length(s: Column) -> Column:
    return F.coalesce(s.end - s.start, F.lit(0))


def measure(utts: DataFrame, *keep: str) -> DataFrame:
    """Events of each type, inserted words and the rate for 100 clean words, all within the row.

    Spans of unknown types count as inserted words, though their events count nowhere. The rate multiplies by 100 / n, which
    keeps values on the published cuts where they belong.
    """
    counts = [_of(t) for t in L.TYPES]
    inserted = F.aggregate("annotations", F.lit(0).cast("long"), lambda acc, a: acc + span_length(a.reparandum) + span_length(a.interregnum))
    out = utts.select("utt_id", "doc_id", "asked_level", "n_clean", *counts, inserted.alias("inserted"), *keep)
    return rated(out.withColumn("n_events", sum((F.col(f"n_{t}") for t in L.TYPES[1:]), F.col(f"n_{L.TYPES[0]}"))))


def rated(counted: DataFrame) -> DataFrame:
    """Rows of n_events and n_clean with their rate."""
    return counted.withColumn("rate", F.col("n_events") * (F.lit(100.0) / F.col("n_clean")))


def eligible(measured: DataFrame) -> DataFrame:
    return measured.filter(F.col("n_clean") >= L.MIN_WORDS)


def cells(measured: DataFrame, *keys: str) -> DataFrame:
    """Eligible utterances counted by clean words and events, with their sums: rates are quotients of these small integers, so
    cuts and levels come exactly from a table of few rows."""
    sums = [F.sum(f"n_{t}").alias(f"n_{t}") for t in L.TYPES]
    return eligible(measured).groupBy(*keys, "n_clean", "n_events", "rate").agg(F.count("*").alias("utterances"), F.sum("n_clean").cast("long").alias("clean_words"), F.sum("n_events").alias("events"), F.sum("inserted").alias("inserted"), *sums)


def cuts_of(counted: DataFrame) -> DataFrame:
    """One row: exact 50th and 90th percentile of the rate over the counted utterances with events (0 if there are none)."""
    at = lambda q: F.coalesce(F.percentile("rate", F.lit(q), F.col("utterances")), F.lit(0.0))
    return counted.filter("n_events > 0").agg(at(0.5).alias("light"), at(0.9).alias("heavy"))


def percentile_cuts(measured: DataFrame) -> DataFrame:
    """The cuts between light, middling and heavy utterances, from n_clean, n_events and rate."""
    return cuts_of(eligible(measured).groupBy("n_events", "rate").agg(F.count("*").alias("utterances")))


def with_level(measured: DataFrame, cuts: DataFrame) -> DataFrame:
    """The level of each utterance: 0 without events, then by the two cuts (one row, joined by broadcast)."""
    level = F.when(F.col("n_events") == 0, 0).when(F.col("rate") >= F.col("heavy"), 3).when(F.col("rate") >= F.col("light"), 2).otherwise(1)
    return measured.crossJoin(F.broadcast(cuts)).withColumn("level", level)


def type_counts(keys: list[str], measured: DataFrame) -> DataFrame:
    return measured.groupBy(*keys).agg(F.sum("n_events").alias("events"), *[F.sum(f"n_{t}").alias(f"n_{t}") for t in L.TYPES])


def added(counted: DataFrame) -> DataFrame:
    """One row: the sums over a few rows of counts."""
    return counted.agg(*[F.sum(c).alias(c) for c in ("events", *[f"n_{t}" for t in L.TYPES])])


def mixes(counted: DataFrame) -> DataFrame:
    """Rows of counts with the share of each type instead (0 without events)."""
    share = [F.when(F.col("events") > 0, F.col(f"n_{t}") / F.col("events")).otherwise(0.0).alias(f"mix_{t}") for t in L.TYPES]
    return counted.select(*[c for c in counted.columns if not c.startswith("n_")], *share)


def summary(grouped_cols: list[str], measured: DataFrame, *more: Column) -> DataFrame:
    """Utterances, words, events, rates, mix and inserted words of each group, and more sums; structural are the events that are no fillers."""
    sums = [F.sum(f"n_{t}").alias(f"n_{t}") for t in L.TYPES]
    g = measured.groupBy(*grouped_cols) if grouped_cols else measured.groupBy()
    out = g.agg(F.count("*").alias("utterances"), F.sum("n_clean").cast("long").alias("clean_words"), F.sum("n_events").alias("events"), F.sum("inserted").alias("inserted"), *sums, *more)
    return with_rates(out)


def with_rates(out: DataFrame) -> DataFrame:
    scale = F.when(F.col("clean_words") > 0, F.lit(100.0) / F.col("clean_words")).otherwise(0.0)
    for t in L.TYPES:
        out = out.withColumn(f"rate_{t}", F.col(f"n_{t}") * scale)
    for t in L.TYPES:
        out = out.withColumn(f"mix_{t}", F.when(F.col("events") > 0, F.col(f"n_{t}") / F.col("events")).otherwise(0.0))
    out = out.withColumn("total_rate", F.col("events") * scale).withColumn("inserted_per_100w", F.col("inserted") * scale)
    return out.withColumn("words_per_event", F.when(F.col("events") > 0, F.col("clean_words") / F.col("events")).otherwise(float("inf"))).drop(*[f"n_{t}" for t in L.TYPES])


def level_table(measured: DataFrame) -> DataFrame:
    """The four levels, each present even if empty, with its share of the eligible utterances. One pass over the utterances."""
    counted = cells(measured)
    names = ["utterances", "clean_words", "events", "inserted", *[f"n_{t}" for t in L.TYPES]]
    by = with_level(counted, cuts_of(counted)).groupBy("level").agg(*[F.sum(c).cast("long").alias(c) for c in names])
    every = measured.sparkSession.range(4).select(F.col("id").cast("int").alias("level"))
    full = every.join(F.broadcast(by), "level", "left").fillna(0)  # at most four rows
    total = F.sum("utterances").over(Window.partitionBy(F.lit(1)))
    full = full.withColumn("pool", total).withColumn("share", F.when(F.col("pool") > 0, F.col("utterances") / F.col("pool")).otherwise(0.0))
    return with_rates(full).drop("pool")


def shape_parameters(utts: DataFrame) -> DataFrame:
    """One row: repairs, share with an editing phrase, spans of their reparanda, and share of two-word repetitions."""
    a = utts.select(F.explode("annotations").alias("a")).select("a.type", span_length(F.col("a.reparandum")).alias("n"), F.col("a.reparandum").isNotNull().alias("has"), F.col("a.interregnum").isNotNull().alias("edited"))
    repair, repetition = F.col("type") == "repair", F.col("type") == "repetition"
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    out = a.agg(
        F.count_if(repair).alias("repairs"), F.count_if(repair & F.col("edited")).alias("edited"), F.count_if(repair & F.col("has")).alias("spans"), F.count_if(repair & (F.col("n") >= 2)).alias("long"),
        F.coalesce(F.sum(F.when(repair & F.col("has"), F.col("n"))), F.lit(0)).alias("words"), F.count_if(repetition & F.col("has")).alias("repetitions"), F.count_if(repetition & (F.col("n") >= 2)).alias("bigrams"),
    )
    c = F.col
    return out.select("repairs", ratio(c("edited"), c("repairs")).alias("interregnum_rate"), ratio(c("long"), c("spans")).alias("span_repair_rate"), ratio(c("words"), c("spans")).alias("mean_repair_span"), ratio(c("bigrams"), c("repetitions")).alias("repetition_bigram_rate"))


def filler_phrases(utts: DataFrame, top: int = 25) -> DataFrame:
    """The most frequent filler phrases with their share of all fillers; ties go by phrase."""
    a = utts.select("disfluent_tokens", F.explode("annotations").alias("a")).filter("a.type = 'filler' and a.interregnum is not null")
    phrase = F.array_join(F.slice("disfluent_tokens", F.col("a.interregnum.start") + 1, span_length(F.col("a.interregnum"))), " ")
    counts = a.groupBy(phrase.alias("phrase")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.orderBy(F.desc("n"), "phrase").limit(top).crossJoin(F.broadcast(total)).select("phrase", "n", (F.col("n") / F.col("total")).alias("share"))


def word_counts(utts: DataFrame) -> DataFrame:
    """word and n over all rows' clean tokens; tokens are counted as they stand first, so each different one is stripped once a task."""
    tokens = utts.select(F.explode("clean_tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return tokens.select(unigram_key(F.col("token")).alias("word"), "n").filter("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def unigrams(utts: DataFrame) -> DataFrame:
    """word, n and log_freq (log10 of the relative frequency) over all rows' clean tokens."""
    counts = word_counts(utts)
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("word", "n", F.log10(F.col("n") / F.col("total")).alias("log_freq"))
