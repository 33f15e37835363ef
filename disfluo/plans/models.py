"""Queries of the scorer with context and of the learned generator; SQL counts and draws alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from disfluo.operators import corpus, detect, evaluate, measure, models
from disfluo.plans.detect_sql import DETECT_SQL
from disfluo.plans.evaluation import _WINDOWS, TARGETS_SQL, targets
from disfluo.plans.rates import UNI_SQL, W, said
from disfluo.plans.texts import CLAUSE, NORM, SPOKEN

SEED = 13


def _bigrams(spark, sf_dir):
    """The scripts' own bigrams."""
    return models.Bigrams(models.bigram_counts(corpus.scripts(spark, sf_dir).select(F.array_join("clean_tokens", " ").alias("text"))))


def context_bits(spark, sf_dir):
    """Bits of each spoken side by the scripts' bigrams: its words, their sum and the dearest word."""
    s = said(spark, sf_dir).select("utt_id", F.array_join("disfluent_tokens", " ").alias("text"))
    b = _bigrams(spark, sf_dir).score(s)
    return b.select("utt_id", F.size("bits").alias("n_words"), F.round(F.aggregate("bits", F.lit(0.0), lambda a, x: a + x), 6).alias("bits"), F.round(F.array_max("bits"), 6).alias("most_bits"))


def context_windows(spark, sf_dir):
    """Windows around repairs, scored by the scripts' bigrams."""
    w = evaluate.scored_windows(said(spark, sf_dir), _bigrams(spark, sf_dir).score)
    return w.select("utt_id", "k", "pos", F.round("data", 6).alias("data"), F.round("control", 6).alias("control"))


def context_effect(spark, sf_dir):
    """Mean bits around repairs on both sides by position."""
    w = evaluate.scored_windows(said(spark, sf_dir), _bigrams(spark, sf_dir).score)
    return w.groupBy("pos").agg(F.count("*").alias("n"), F.round(F.avg("data"), 6).alias("data"), F.round(F.avg("control"), 6).alias("control"), F.round(F.avg(F.col("data") - F.col("control")), 6).alias("effect"))


def markov_speech(spark, sf_dir):
    """Every script as the chain that was learned from the corpus says it."""
    return models.markov(said(spark, sf_dir), SEED).speak(corpus.scripts(spark, sf_dir)).select("utt_id", "asked_level", "spoken")


def markov_rates(spark, sf_dir):
    """What the detector finds in the chain's speech, level by level, against the targets."""
    s = corpus.scripts(spark, sf_dir)
    found = detect.detected(models.markov(said(spark, sf_dir), SEED).speak(s).select("utt_id", "asked_level", "clean", "spoken"))
    m = measure.measure(found.withColumn("n_clean", F.size("clean_tokens")).withColumn("doc_id", F.lit(0).cast("long")))
    run = measure.summary(["asked_level"], m).join(targets(spark, sf_dir), "asked_level")
    return run.select("asked_level", "utterances", "clean_words", "events", "total_rate", "target", F.when(F.col("target") > 0, F.col("total_rate") / F.col("target")).otherwise(0.0).alias("ratio"))


QUERIES = {f.__name__: f for f in (context_bits, context_windows, context_effect, markov_speech, markov_rates)}

#: Relation bits (utt_id, side, i, b) of the spoken side and the script's spoken form, by the scripts' bigrams.
_BITS = f"""bg AS (SELECT before, word, count(*) AS n FROM (SELECT {NORM("word")} AS word, coalesce(lag({NORM("word")}) OVER (PARTITION BY utt_id ORDER BY i), '<s>') AS before FROM wd) GROUP BY ALL),
ctx AS (SELECT before, count(*) AS followers, sum(n) AS times FROM bg GROUP BY before), own AS (SELECT word, sum(n) AS own FROM bg GROUP BY word),
total AS (SELECT coalesce(sum(own), 0) AS every, count(*) AS known FROM own),
tk AS (SELECT utt_id, 'said' AS side, unnest(disfluent_tokens) AS w, generate_subscripts(disfluent_tokens, 1) - 1 AS i FROM utt UNION ALL SELECT utt_id, 'meant', {SPOKEN("word")}, i FROM wd),
tb AS (SELECT utt_id, side, i, {NORM("w")} AS word, coalesce(lag({NORM("w")}) OVER (PARTITION BY utt_id, side ORDER BY i), '<s>') AS before FROM tk),
pr AS (SELECT utt_id, side, i, n, followers, times, (coalesce(own, 0) + CAST(1 AS DOUBLE) / (known + 1)) / (every + 1) AS p1 FROM tb LEFT JOIN bg USING (before, word) LEFT JOIN ctx USING (before) LEFT JOIN own USING (word), total),
bits AS (SELECT utt_id, side, i, -log2(CASE WHEN times > 0 THEN (coalesce(n, 0) + followers * p1) / CAST(times + followers AS DOUBLE) ELSE p1 END) AS b FROM pr)"""
_AROUND = f"""{_WINDOWS}, cw AS (SELECT wn.utt_id, wn.k, wn.pos, x.b AS data, y.b AS control FROM wn JOIN rp USING (utt_id, k)
JOIN bits x ON x.utt_id = wn.utt_id AND x.side = 'said' AND x.i = rp.b + wn.pos JOIN bits y ON y.utt_id = wn.utt_id AND y.side = 'meant' AND y.i = rp.c + wn.pos)"""
#: Relation spk (utt_id, asked_level, words) of the chain: states as lists of kinds with their cumulated counts, walked word by word.
_CHAIN = f"""kd AS (SELECT wd.utt_id, wd.i, wd.asked_level, wd.word, wd.i = 0 OR coalesce({CLAUSE("lag(word) OVER (PARTITION BY wd.utt_id ORDER BY wd.i)")}, false) AS onset, coalesce(type, 'none') AS kind, head FROM wd LEFT JOIN ann ON ann.utt_id = wd.utt_id AND ann.i = wd.i),
tr AS (SELECT asked_level, prev, onset, kind, count(*) AS n FROM (SELECT *, coalesce(lag(kind) OVER (PARTITION BY utt_id ORDER BY i), 'none') AS prev FROM kd) GROUP BY ALL),
sm AS (SELECT asked_level, prev, onset, list(kind ORDER BY kind) AS kinds, list(upto ORDER BY kind) AS uptos, max(upto) AS total FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY asked_level, prev, onset ORDER BY kind) AS BIGINT) AS upto FROM tr) GROUP BY ALL),
pn AS (SELECT kind, array_to_string(head, ' ') AS phrase, count(*) AS n FROM kd WHERE kind NOT IN ('none', 'repetition') GROUP BY ALL),
pm AS (SELECT kind, list(phrase ORDER BY n DESC, phrase) AS phrases, list(upto ORDER BY n DESC, phrase) AS uptos, max(upto) AS total FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY kind ORDER BY n DESC, phrase) AS BIGINT) AS upto FROM pn) GROUP BY kind),
dg AS (SELECT utt_id, asked_level, i, onset, {SPOKEN("word")} AS own, CAST(('0x' || substr(h, 1, 8)) AS BIGINT) AS u, CAST(('0x' || substr(h, 9, 8)) AS BIGINT) AS v FROM (SELECT *, md5('{SEED}:' || asked_level || ':' || utt_id || ':' || i) AS h FROM kd)),
mk AS (SELECT utt_id, CAST(-1 AS BIGINT) AS i, 'none' AS kind FROM scripts UNION ALL
  SELECT d.utt_id, CAST(d.i AS BIGINT), coalesce(sm.kinds[1 + len(list_filter(sm.uptos, lambda x: CAST(x AS HUGEINT) * 4294967296 <= CAST(d.u AS HUGEINT) * sm.total))], 'none')
  FROM mk JOIN dg d ON d.utt_id = mk.utt_id AND d.i = mk.i + 1 LEFT JOIN sm ON sm.asked_level = d.asked_level AND sm.prev = mk.kind AND sm.onset = d.onset),
hd AS (SELECT d.*, CASE WHEN mk.kind = 'repetition' THEN own WHEN mk.kind <> 'none' THEN pm.phrases[1 + len(list_filter(pm.uptos, lambda x: CAST(x AS HUGEINT) * 4294967296 <= CAST(d.v AS HUGEINT) * pm.total))] END AS head
  FROM dg d JOIN mk ON mk.utt_id = d.utt_id AND mk.i = d.i LEFT JOIN pm ON pm.kind = mk.kind),
spk AS (SELECT utt_id, asked_level, string_agg(coalesce(head || ' ', '') || own, ' ' ORDER BY i) AS spoken FROM hd GROUP BY ALL)"""
_R = W.replace("WITH", "WITH RECURSIVE", 1)
_SAID = f"""pairs AS (SELECT utt_id, spk.asked_level, list_transform(clean_tokens, lambda w: {SPOKEN("w")}) AS a, string_split(spoken, ' ') AS b FROM spk JOIN scripts USING (utt_id))"""

ORACLES = {
    "context_bits": f"{W}, {_BITS} SELECT utt_id, CAST(count(*) AS INTEGER) AS n_words, round(sum(b), 6) AS bits, round(max(b), 6) AS most_bits FROM bits WHERE side = 'said' GROUP BY utt_id",
    "context_windows": f"{W}, {UNI_SQL}, {_BITS}, {_AROUND} SELECT utt_id, k, pos, round(data, 6) AS data, round(control, 6) AS control FROM cw",
    "context_effect": f"{W}, {UNI_SQL}, {_BITS}, {_AROUND} SELECT pos, count(*) AS n, round(avg(data), 6) AS data, round(avg(control), 6) AS control, round(avg(data - control), 6) AS effect FROM cw GROUP BY pos",
    "markov_speech": f"{_R}, {_CHAIN} SELECT utt_id, asked_level, spoken FROM spk",
    "markov_rates": f"""{_R}, {TARGETS_SQL}, {_CHAIN}, {_SAID}, {DETECT_SQL}, fe AS (SELECT utt_id, count(*) AS n FROM found GROUP BY utt_id),
g AS (SELECT asked_level, count(*) AS utterances, CAST(sum(len(a)) AS BIGINT) AS clean_words, CAST(coalesce(sum(n), 0) AS BIGINT) AS events FROM pairs LEFT JOIN fe USING (utt_id) GROUP BY asked_level),
r AS (SELECT *, events * (100.0 / CAST(clean_words AS DOUBLE)) AS total_rate FROM g)
SELECT asked_level, utterances, clean_words, events, total_rate, target, CASE WHEN target > 0 THEN total_rate / target ELSE 0.0 END AS ratio FROM r JOIN targets USING (asked_level)""",
}
