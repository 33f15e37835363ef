"""Several systems side by side: their order in reports, fidelity, rate errors and copy failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from disfluo.functions import lexicon as L
from disfluo.operators import detect, evaluate, measure

#: Systems in the order of reports; others follow by name.
ORDER = ("model", "model greedy", "injector", "corpus")


def rank(system: Column) -> Column:
    out = F.lit(len(ORDER))
    for k, name in enumerate(ORDER):
        out = F.when(system == name, k).otherwise(out)
    return out


def placed(table: DataFrame, system: str = "system", level: str = "asked_level") -> DataFrame:
    """A report's few rows with their place: by system, then by level, rows without a level last."""
    order = Window.orderBy(rank(F.col(system)), system, F.col(level).asc_nulls_last())
    return table.withColumn("place", F.row_number().over(order))


def by_count(cells: DataFrame) -> DataFrame:
    """Cells of a confusion (25 at most) with their place: the most frequent first."""
    return cells.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "gold", "found")))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def rate_table(measured: DataFrame, targets: DataFrame) -> DataFrame:
    """Rates of each system and level against the level's target; no ratio where nothing is asked for."""
    run = measure.summary(["system", "asked_level"], measured).join(targets, "asked_level")
    return placed(run.withColumn("ratio", F.when(F.col("target") > 0, F.col("total_rate") / F.col("target"))))


def rate_errors(table: DataFrame) -> DataFrame:
    """Mean absolute and relative error of each system over the levels that ask for events."""
    d = F.abs(F.col("total_rate") - F.col("target"))
    return table.filter("asked_level > 0").groupBy("system").agg(F.round(F.avg(d), 9).alias("mean_absolute_error"), F.round(F.avg(d / F.col("target")), 9).alias("mean_relative_error"))


def mix_table(measured: DataFrame, reference: str = "corpus") -> DataFrame:
    """Type mix of each system and level, and its divergence from the reference's mix at the same level."""
    run = measure.mixes(measure.type_counts(["system", "asked_level"], measured))
    ref = F.broadcast(run.filter(F.col("system") == reference).select("asked_level", *[F.col(f"mix_{t}").alias(f"ref_{t}") for t in L.TYPES]))  # a row for each level
    out = run.join(ref, "asked_level").withColumn("kl_bits", F.round(evaluate.divergence_bits(), 9))
    return placed(out.drop(*[f"ref_{t}" for t in L.TYPES]))


def fidelity_table(detected: DataFrame) -> DataFrame:
    """How much of the scripts is kept, from rows with system, asked_level, clean_tokens and dropped."""
    words, lost = F.size("clean_tokens"), F.size("dropped")
    out = detected.groupBy("system", "asked_level").agg(F.count("*").alias("sentences"), F.sum(words).cast("long").alias("clean_words"), F.sum(lost).cast("long").alias("dropped"), F.count_if(lost > 0).alias("sentences_with_drop"))
    return placed(out.withColumn("kept", F.when(F.col("clean_words") > 0, 1 - F.col("dropped") / F.col("clean_words")).otherwise(0.0)).withColumn("share_with_drop", ratio(F.col("sentences_with_drop"), F.col("sentences"))))


def placement_table(records: DataFrame, scripts: DataFrame, words: DataFrame, level: int = 2) -> DataFrame:
    """Placement of each system's fillers at a level beside a random word of the same system's scripts. A system without a
    filler there has n = 0."""
    keep = ("n", "at_clause_onset", "before_content_word", "mean_next_log_freq", "n_mid_clause", "mid_clause_next_log_freq")
    measured = evaluate.placement(records.filter(F.col("asked_level") == level), words, "system")
    base = evaluate.placement_baseline(scripts.filter(F.col("asked_level") == level), words, "system").select("system", *[F.col(c).alias(f"baseline_{c}") for c in keep])
    out = base.join(measured, "system", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = out.select("system", F.lit(level).alias("asked_level"), *[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes if c != "system"])
    return placed(out.withColumn("lift", F.round(ratio(F.col("at_clause_onset"), F.col("baseline_at_clause_onset")), 9)))


def copy_failure(said: DataFrame, scripts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Rates and kept words of each system, for scripts with and without a word outside the vocabulary.

    said: system, utt_id, own (the script's words in their spoken form) and disfluent_tokens, which the detector is to compare; scripts:
    utt_id and clean_tokens. A pair goes through the detector once, and only its numbers meet the scripts' flags.
    """
    numbers = detect.counted(said.select("system", "utt_id", "own", "disfluent_tokens")).drop("own", "disfluent_tokens")
    m = numbers.join(evaluate.with_unseen(scripts, vocabulary).withColumn("_u", F.lit(True)), "utt_id", "left").withColumn("has_unseen", F.coalesce("_u", F.lit(False)))
    out = measure.summary(["system", "has_unseen"], m, F.sum("lost").alias("dropped"))
    out = out.select(*[c for c in out.columns if c != "dropped"], "dropped")
    return out.withColumn("kept", F.when(F.col("clean_words") > 0, 1 - F.col("dropped") / F.col("clean_words")).otherwise(0.0))
