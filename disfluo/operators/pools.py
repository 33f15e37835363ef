"""Source pools: template sentences, held-out templates, and the cut into train, val and test."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from disfluo.functions.templates import TEMPLATES, VALUES
from disfluo.operators.corpus import uniform
from disfluo.operators.inject import below
from disfluo.operators.ordering import seeded, three_way


def template_sentences(spark: SparkSession, templates: tuple | list = TEMPLATES, slots: dict = VALUES, each: int = 100, seed: str = "13") -> DataFrame:
    """template_id and text: up to ``each`` distinct fillings of each template.

    A slot is written ``{name}``; ``{name2}`` takes a value other than ``{name}``'s; a repeated slot repeats its value. Values
    are picked by a hash of seed, template, draw and slot, so every draw is a row of its own and nothing is sequential.
    """
    rows = spark.createDataFrame(list(enumerate(templates)), "template_id int, text string")
    draws = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(3 * each - 1))))
    at = lambda name, n: F.floor(uniform(seed, "slot", F.col("template_id"), F.col("draw"), name) * n).cast("int")
    text: Column = F.col("text")
    for name, values in slots.items():
        n = len(values)
        other = F.pmod(at(name, n) + 1 + at(name + "2", max(1, n - 1)), F.lit(n))
        pick = F.array(*map(F.lit, values))
        text = F.replace(F.replace(text, F.lit("{" + name + "2}"), F.get(pick, other)), F.lit("{" + name + "}"), F.get(pick, at(name, n)))
    filled = draws.select("template_id", "draw", text.alias("text")).groupBy("template_id", "text").agg(F.min("draw").alias("draw"))
    rank = F.row_number().over(Window.partitionBy("template_id").orderBy("draw"))
    return filled.withColumn("rank", rank).filter(F.col("rank") <= each).select("template_id", "text")


def build_pools(corpus_sentences: DataFrame, from_templates: DataFrame, seed: str = "13", train: float = 0.8, val: float = 0.04, held_out: float = 0.2) -> DataFrame:
    """text, source, template_id and split: corpus sentences cut three ways, templates the same except a share held out for test."""
    ids = from_templates.select("template_id").distinct()
    total = ids.count()
    held = ids.orderBy(seeded(seed, "template_id"), "template_id").limit(round(held_out * total)).withColumn("held", F.lit(True))
    parts = three_way(corpus_sentences.select("text").distinct(), "text", seed, train, val).select("text", F.lit("corpus").alias("source"), F.lit(None).cast("int").alias("template_id"), "split")
    t = from_templates.join(F.broadcast(held), "template_id", "left")  # one row for each template
    seen = three_way(t.filter("held is null").select("template_id", "text"), "text", seed, train, val).select("text", F.lit("template").alias("source"), "template_id", "split")
    return parts.unionByName(seen).unionByName(t.filter("held").select("text", F.lit("template").alias("source"), "template_id", F.lit("test").alias("split")))


#: Rows of a level that ``balanced`` orders at first, for each that it draws; where copies of few sentences fill them, it takes more.
AHEAD = 64


def balanced(measured: DataFrame, sentence: str, seed: str, each: int, ahead: int = AHEAD) -> DataFrame:
    """At most ``each`` rows of each level, no sentence twice, from sentences said at several levels and labelled by what was
    measured: the level with the fewest rows chooses first, ties going to the lower level; rows come in a seeded order.

    Only rows whose hash lies below a level's bound are put in order: a row beyond it comes after all of them, so the draw is the
    same as long as they hold enough sentences; if not, the bounds are raised until they do or all rows are below.
    """
    rows = measured.persist()  # read for the sizes and for the draw
    sizes = {r["level"]: r["n"] for r in rows.groupBy("level").agg(F.count("*").alias("n")).collect()}  # at most four rows
    order = sorted(sizes, key=lambda k: (sizes[k], k))
    if not order:
        return rows
    hashed = rows.withColumn("h", seeded(seed, "utt_id"))
    while True:
        share = {k: ahead * each / sizes[k] for k in order}
        near = hashed
        if min(share.values()) < 1:
            near = hashed.filter(reduce(or_, [(F.col("level") == k) & (F.col("h") < below(share[k], 12) if share[k] < 1 else F.lit(True)) for k in order])).persist()
        chosen, got, drawn = [], {}, near.select(sentence, "utt_id", "level").limit(0)
        for level in order:
            own = near.filter(F.col("level") == level)
            if chosen:
                own = own.join(F.broadcast(drawn.select(sentence)), sentence, "left_anti")
            first = own.groupBy(sentence).agg(F.min(F.struct("h", "utt_id")).alias("least")).orderBy("least").limit(each)  # a sentence once
            new = [(r[sentence], r["least"]["utt_id"], level) for r in first.collect()]  # each at most
            chosen, got[level] = chosen + new, len(new)
            drawn = near.sparkSession.createDataFrame(chosen, drawn.schema)
        if all(got[k] >= each or share[k] >= 1 for k in order):
            return near.join(F.broadcast(drawn.select("utt_id", "level")), ["utt_id", "level"], "left_semi").select(*measured.columns)
        near.unpersist()
        ahead *= 16
