"""Queries of the dial: event rates, percentile cuts, levels, shapes and frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from disfluo.functions import lexicon as L
from disfluo.operators import corpus, measure

UNI_KEY = "lower(trim(w, '" + L.UNIGRAM_STRIP.replace("'", "''") + "'))"
UNI_SQL = f"""uw AS (SELECT {UNI_KEY} AS word FROM (SELECT unnest(clean_tokens) AS w FROM scripts)),
uni AS (SELECT word, count(*) AS n, log10(count(*) / CAST((SELECT count(*) FROM uw WHERE word <> '') AS DOUBLE)) AS log_freq FROM uw WHERE word <> '' GROUP BY word)"""
CUTS_SQL = f"cuts AS (SELECT coalesce(quantile_cont(rate, 0.5), 0.0) AS light, coalesce(quantile_cont(rate, 0.9), 0.0) AS heavy FROM ms WHERE n_clean >= {L.MIN_WORDS} AND n_events > 0)"
LEVEL_SQL = "CASE WHEN n_events = 0 THEN 0 WHEN rate >= heavy THEN 3 WHEN rate >= light THEN 2 ELSE 1 END"


def rates_sql(source: str, keys: str) -> str:
    """Columns of measure.with_rates over a relation that has the sums."""
    scale = "CASE WHEN clean_words > 0 THEN 100.0 / CAST(clean_words AS DOUBLE) ELSE 0.0 END"
    each = ", ".join([f"n_{t} * ({scale}) AS rate_{t}" for t in L.TYPES] + [f"CASE WHEN events > 0 THEN n_{t} / CAST(events AS DOUBLE) ELSE 0.0 END AS mix_{t}" for t in L.TYPES])
    return (
        f"SELECT {keys} utterances, clean_words, events, inserted, {each}, events * ({scale}) AS total_rate, inserted * ({scale}) AS inserted_per_100w, "
        f"CASE WHEN events > 0 THEN clean_words / CAST(events AS DOUBLE) ELSE CAST('infinity' AS DOUBLE) END AS words_per_event FROM {source}"
    )


SUMS_SQL = "count(*) AS utterances, CAST(sum(n_clean) AS BIGINT) AS clean_words, CAST(sum(n_events) AS BIGINT) AS events, CAST(sum(inserted) AS BIGINT) AS inserted, " + ", ".join(f"CAST(sum(n_{t}) AS BIGINT) AS n_{t}" for t in L.TYPES)


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.spoken(corpus.scripts(spark, sf_dir))


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.measure(said(spark, sf_dir))


def measure_rates(spark, sf_dir):
    return measure.summary(["asked_level"], measured(spark, sf_dir))


def corpus_totals(spark, sf_dir):
    return measure.summary([], measured(spark, sf_dir))


def level_table(spark, sf_dir):
    return measure.level_table(measured(spark, sf_dir))


def percentile_cuts(spark, sf_dir):
    return measure.percentile_cuts(measured(spark, sf_dir))


def level_labels(spark, sf_dir):
    m = measured(spark, sf_dir)
    return measure.with_level(measure.eligible(m), measure.percentile_cuts(m)).select("utt_id", "asked_level", "n_clean", "n_events", "inserted", "rate", "level")


def utterance_measures(spark, sf_dir):
    return measured(spark, sf_dir)


def shape_parameters(spark, sf_dir):
    return measure.shape_parameters(said(spark, sf_dir))


def filler_phrases_top25(spark, sf_dir):
    return measure.filler_phrases(said(spark, sf_dir))


def unigram_log_freq(spark, sf_dir):
    return measure.unigrams(corpus.scripts(spark, sf_dir))


def split_summary(spark, sf_dir):
    """Pairs of each asked and measured level, their words, their events in all, by type and for each 100 words."""
    counted = measure.cells(measured(spark, sf_dir), "asked_level")
    out = measure.with_level(counted, measure.cuts_of(counted))
    sums = out.groupBy("asked_level", "level").agg(F.sum("utterances").alias("pairs"), *[F.sum(c).cast("long").alias(c) for c in ("clean_words", "events", *[f"n_{t}" for t in L.TYPES])])
    return sums.withColumn("events_per_100w", F.when(F.col("clean_words") > 0, F.col("events") * (F.lit(100.0) / F.col("clean_words"))).otherwise(0.0))


W = "WITH " + corpus.CORPUS_SQL
QUERIES = {f.__name__: f for f in (measure_rates, corpus_totals, level_table, percentile_cuts, level_labels, utterance_measures, shape_parameters, filler_phrases_top25, unigram_log_freq, split_summary)}
ORACLES = {
    "measure_rates": f"{W}, g AS (SELECT asked_level, {SUMS_SQL} FROM ms GROUP BY asked_level) {rates_sql('g', 'asked_level,')}",
    "corpus_totals": f"{W}, g AS (SELECT {SUMS_SQL} FROM ms) {rates_sql('g', '')}",
    "level_table": f"""{W}, {CUTS_SQL}, lv AS (SELECT *, {LEVEL_SQL} AS level FROM ms, cuts WHERE n_clean >= {L.MIN_WORDS}),
g AS (SELECT level, {SUMS_SQL} FROM lv GROUP BY level), f AS (SELECT CAST(r.level AS INTEGER) AS level, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ["utterances", "clean_words", "events", "inserted", *[f"n_{t}" for t in L.TYPES]])} FROM range(4) r(level) LEFT JOIN g USING (level)),
p AS (SELECT *, utterances / CAST((SELECT sum(utterances) FROM f) AS DOUBLE) AS share FROM f) {rates_sql("p", "level, share,")}""",
    "percentile_cuts": f"{W}, {CUTS_SQL} SELECT light, heavy FROM cuts",
    "level_labels": f"{W}, {CUTS_SQL} SELECT utt_id, asked_level, n_clean, n_events, inserted, rate, {LEVEL_SQL} AS level FROM ms, cuts WHERE n_clean >= {L.MIN_WORDS}",
    "utterance_measures": f"{W} SELECT utt_id, doc_id, asked_level, n_clean, n_filler, n_repetition, n_repair, n_false_start, n_events, inserted, rate FROM ms",
    "shape_parameters": f"""{W}, a AS (SELECT type, rep_e - rep_s AS n, int_s IS NOT NULL AS edited FROM ann), c AS (SELECT count(*) FILTER (type = 'repair') AS repairs, count(*) FILTER (type = 'repair' AND edited) AS ed,
count(*) FILTER (type = 'repair' AND n IS NOT NULL) AS sp, count(*) FILTER (type = 'repair' AND n >= 2) AS lo, coalesce(sum(n) FILTER (type = 'repair'), 0) AS wo, count(*) FILTER (type = 'repetition') AS re, count(*) FILTER (type = 'repetition' AND n >= 2) AS bi FROM a)
SELECT repairs, CAST(ed AS DOUBLE) / repairs AS interregnum_rate, CAST(lo AS DOUBLE) / sp AS span_repair_rate, CAST(wo AS DOUBLE) / sp AS mean_repair_span, CAST(bi AS DOUBLE) / re AS repetition_bigram_rate FROM c""",
    "filler_phrases_top25": f"{W}, c AS (SELECT array_to_string(head, ' ') AS phrase, count(*) AS n FROM ann WHERE type = 'filler' GROUP BY 1) SELECT phrase, n, n / CAST((SELECT sum(n) FROM c) AS DOUBLE) AS share FROM c ORDER BY n DESC, phrase LIMIT 25",
    "unigram_log_freq": f"{W}, {UNI_SQL} SELECT word, n, log_freq FROM uni",
    "split_summary": f"{W}, {CUTS_SQL}, lv AS (SELECT *, {LEVEL_SQL} AS level FROM ms, cuts WHERE n_clean >= {L.MIN_WORDS}) SELECT asked_level, level, count(*) AS pairs, CAST(sum(n_clean) AS BIGINT) AS clean_words, CAST(sum(n_events) AS BIGINT) AS events, {', '.join(f'CAST(sum(n_{t}) AS BIGINT) AS n_{t}' for t in L.TYPES)}, sum(n_events) * (100.0 / CAST(sum(n_clean) AS DOUBLE)) AS events_per_100w FROM lv GROUP BY ALL",
}
