"""Queries with several systems side by side: the corpus, a second rendering of its scripts, and one that loses words."""

from __future__ import annotations

from pyspark.sql import functions as F

from disfluo.functions import lexicon as L
from disfluo.functions.text import spoken_form
from disfluo.operators import corpus, detect, evaluate, measure, report
from disfluo.plans.detect_sql import CONFUSION_SQL, DETECT_SQL, PAIRS_SQL
from disfluo.plans.evaluation import _BASE, _GOLD, _PLACE, TARGETS_SQL, targets
from disfluo.plans.rates import SUMS_SQL, UNI_SQL, W, rates_sql
from disfluo.plans.texts import NORM, SPOKEN, WORDS_ONLY

#: Systems and the seeds of their renderings.
SEEDS = {"corpus": "say", "injector": "run"}


def runs(spark, sf_dir):
    """Every script as each system says it."""
    s = corpus.scripts(spark, sf_dir)
    a, b = (corpus.spoken(s, seed).withColumn("system", F.lit(name)) for name, seed in SEEDS.items())
    return a.unionByName(b)


def detected(spark, sf_dir, *systems):
    """What the detector finds in the given systems' speech, or in all: also in that of one that loses the last word of each script. Utterances
    are numbered anew, one number for each system's. Systems are chosen before detecting, as the detector holds later filters back."""
    out, s = None, corpus.scripts(spark, sf_dir)
    own = F.transform("clean_tokens", spoken_form)
    for number, system in enumerate((*SEEDS, "lossy")):
        if systems and system not in systems:
            continue
        said = corpus.spoken(s, SEEDS[system]).withColumn("spoken", F.array_join("disfluent_tokens", " ")) if system in SEEDS else s.withColumn("spoken", F.array_join(F.slice(own, F.lit(1), F.size(own) - 1), " "))
        one = said.select(F.lit(system).alias("system"), (F.col("utt_id") * 3 + number).alias("utt_id"), "asked_level", "clean", "spoken")
        out = one if out is None else out.unionByName(one)
    return detect.detected(out)


def system_rates(spark, sf_dir):
    return report.rate_table(measure.measure(runs(spark, sf_dir), "system"), targets(spark, sf_dir))


def system_rate_error(spark, sf_dir):
    return report.rate_errors(system_rates(spark, sf_dir))


def system_mix(spark, sf_dir):
    return report.mix_table(measure.measure(runs(spark, sf_dir), "system"))


def system_placement(spark, sf_dir):
    r = runs(spark, sf_dir)
    return report.placement_table(evaluate.records(r, "system"), r, measure.unigrams(corpus.scripts(spark, sf_dir)))


def system_fidelity(spark, sf_dir):
    return report.fidelity_table(detected(spark, sf_dir))


def system_copy_failure(spark, sf_dir, level: int = 2):
    """All systems' speech of a level's scripts, from one reading of them; words are counted over the scripts of all levels."""
    s = corpus.scripts(spark, sf_dir, level)
    systems = F.array(*[F.struct(F.lit(name).alias("system"), F.lit(seed).alias("seed")) for name, seed in SEEDS.items()])
    asked = s.withColumn("own", F.transform("clean_tokens", spoken_form)).withColumn("by", F.explode(systems))
    said = corpus.spoken(asked, F.col("by.seed"), "by", "own", own="own").withColumn("system", F.col("by.system"))
    speech = lambda system, words: F.struct(system.alias("system"), words.alias("words"))
    one, lossy = speech(F.col("system"), F.col("disfluent_tokens")), speech(F.lit("lossy"), F.slice("own", F.lit(1), F.size("own") - 1))
    each = F.explode(F.when(F.col("system") == "corpus", F.array(one, lossy)).otherwise(F.array(one))).alias("x")
    said = said.select("utt_id", "own", each).select("utt_id", "own", "x.system", F.col("x.words").alias("disfluent_tokens"))
    return report.copy_failure(said, s, measure.word_counts(corpus.scripts(spark, sf_dir)).filter("n >= 2"))


def system_round_trip(spark, sf_dir):
    """Recovery of the injector's scripts by a cleaner that does nothing, by one that loses each script's last word and by one that swaps
    its first two words and puts another in the fourth's place, level by level, and of the corpus's by one that undoes annotations, at no level."""
    r = runs(spark, sf_dir)
    as_is = r.filter("system = 'injector'").select("system", "asked_level", F.array_join("clean_tokens", " ").alias("original"), F.array_join("disfluent_tokens", " ").alias("recovered"))
    undone = r.filter("system = 'corpus'").select("system", F.lit(None).cast("int").alias("asked_level"), F.array_join("clean_tokens", " ").alias("original"), evaluate.without_disfluencies().alias("recovered"))
    words, n = F.col("clean_tokens"), F.size("clean_tokens")
    other = F.transform(words, lambda w, i: F.when(i == 0, F.get(words, F.lit(1))).when(i == 1, F.get(words, F.lit(0))).when(i == 3, F.lit("other")).otherwise(w))
    s = corpus.scripts(spark, sf_dir)
    worse = [s.select(F.lit(name).alias("system"), "asked_level", F.array_join(words, " ").alias("original"), F.array_join(said, " ").alias("recovered")) for name, said in (("lossy", F.slice(words, F.lit(1), n - 1)), ("swapped", other))]
    return report.placed(evaluate.recovery(as_is.unionByName(undone).unionByName(worse[0]).unionByName(worse[1]), "system", "asked_level"))


def detector_confusion_ordered(spark, sf_dir):
    found = detected(spark, sf_dir, "corpus").withColumn("utt_id", F.expr("utt_id div 3"))
    return report.by_count(detect.confusion(corpus.spoken(corpus.scripts(spark, sf_dir)), found))


def detector_report(spark, sf_dir):
    """One row: utterances, those that lose a word, and gold and detected events of each type."""
    gold = measure.measure(corpus.spoken(corpus.scripts(spark, sf_dir))).select("utt_id", *[F.col(f"n_{t}").alias(f"gold_{t}") for t in L.TYPES])
    found = detected(spark, sf_dir, "corpus")
    d = measure.measure(found.withColumn("n_clean", F.size("clean_tokens")).withColumn("doc_id", F.lit(0).cast("long")).withColumn("lost", F.size("dropped")), "lost")
    both = gold.join(d.withColumn("utt_id", F.expr("utt_id div 3")), "utt_id")
    sums = [F.sum(f"{a}_{t}").alias(f"{b}_{t}") for a, b in (("gold", "gold"), ("n", "detected")) for t in L.TYPES]
    return both.agg(F.count("*").alias("utterances"), F.count_if(F.col("lost") > 0).alias("utterances_with_drop"), *sums)


QUERIES = {f.__name__: f for f in (
    system_rates, system_rate_error, system_mix, system_placement, system_fidelity, system_copy_failure, system_round_trip, detector_confusion_ordered, detector_report)}

_RUN = corpus.spoken_sql("_r", seed="run")
_W2 = f"{W},{_RUN}"
_MS = f"both_ms AS (SELECT 'corpus' AS system, * FROM ms UNION ALL SELECT 'injector', * FROM ms_r)"
_RANK = "CASE system " + " ".join(f"WHEN '{n}' THEN {k}" for k, n in enumerate(report.ORDER)) + f" ELSE {len(report.ORDER)} END"
_AT = f"CAST(row_number() OVER (ORDER BY {_RANK}, system, asked_level NULLS LAST) AS INTEGER) AS place"
_RATES = f"""{_MS}, {TARGETS_SQL}, g AS (SELECT system, asked_level, {SUMS_SQL} FROM both_ms GROUP BY ALL), r AS ({rates_sql("g", "system, asked_level,")}),
sr AS (SELECT *, CASE WHEN target > 0 THEN total_rate / target END AS ratio, {_AT} FROM r JOIN targets USING (asked_level))"""
_MIX = ", ".join(f"coalesce(sum(n_{t}) / CAST(nullif(sum(n_events), 0) AS DOUBLE), 0.0) AS mix_{t}" for t in L.TYPES)
_KL = " + ".join(f"CASE WHEN p.mix_{t} > 0 THEN p.mix_{t} / ptotal * log2(p.mix_{t} / ptotal / ((q.mix_{t} + 0.001) / (qtotal + 4 * 0.001))) ELSE 0.0 END" for t in L.TYPES)
_TOTAL = lambda a: "(" + " + ".join(f"{a}.mix_{t}" for t in L.TYPES) + ")"
_PLACED = ("n", "at_clause_onset", "before_content_word", "mean_next_log_freq", "n_mid_clause", "mid_clause_next_log_freq")
_RENAMED = _GOLD.replace("rec AS", "rec_r AS").replace(" ann ", " ann_r ") + ", " + _PLACE.replace("pl AS", "pl_r AS").replace(" rec ", " rec_r ")
#: Pairs of the three systems, numbered like the query's.
_THREE = f"""pairs AS (SELECT utt_id * 3 AS utt_id, asked_level, list_transform(clean_tokens, lambda w: {SPOKEN("w")}) AS a, disfluent_tokens AS b FROM utt
UNION ALL SELECT utt_id * 3 + 1, asked_level, list_transform(clean_tokens, lambda w: {SPOKEN("w")}), disfluent_tokens FROM utt_r
UNION ALL SELECT utt_id * 3 + 2, asked_level, s, s[1 : len(s) - 1] FROM (SELECT utt_id, asked_level, list_transform(clean_tokens, lambda w: {SPOKEN("w")}) AS s FROM scripts))"""
_NAME = "CASE utt_id % 3 WHEN 0 THEN 'corpus' WHEN 1 THEN 'injector' ELSE 'lossy' END AS system"
_W3 = f"{_W2.replace('WITH', 'WITH RECURSIVE', 1)}, {_THREE}, {DETECT_SQL}"
_D = f"d AS (SELECT utt_id, {', '.join(f'''count(*) FILTER (type = '{t}') AS n_{t}''' for t in L.TYPES)}, count(*) AS n_events, sum(past - first) AS inserted FROM found GROUP BY utt_id)"
_RECOVERED = f"w AS (SELECT *, rtrim(a, '.!?') = rtrim(b, '.!?') AS exact, {WORDS_ONLY('a')} AS x, {WORDS_ONLY('b')} AS y FROM p)"
ORACLES = {
    "system_rates": f"{_W2}, {_RATES} SELECT * FROM sr",
    "system_rate_error": f"{_W2}, {_RATES} SELECT system, round(avg(abs(total_rate - target)), 9) AS mean_absolute_error, round(avg(abs(total_rate - target) / target), 9) AS mean_relative_error FROM sr WHERE asked_level > 0 GROUP BY system",
    "system_mix": f"""{_W2}, {_MS}, m AS (SELECT system, asked_level, CAST(sum(n_events) AS BIGINT) AS events, {_MIX} FROM both_ms GROUP BY ALL),
k AS (SELECT p.*, round({_KL}, 9) AS kl_bits FROM (SELECT *, CASE WHEN {_TOTAL("m")} > 0 THEN {_TOTAL("m")} ELSE 1.0 END AS ptotal FROM m) p JOIN (SELECT *, {_TOTAL("m")} AS qtotal FROM m WHERE system = 'corpus') q USING (asked_level))
SELECT * EXCLUDE (ptotal), {_AT} FROM k""",
    "system_placement": f"""{_W2}, {UNI_SQL}, {_GOLD}, {_PLACE}, {_RENAMED}, {_BASE},
m AS (SELECT 'corpus' AS system, * FROM pl UNION ALL SELECT 'injector', * FROM pl_r)
SELECT system, asked_level, {", ".join(f"m.{c}" for c in _PLACED)}, {", ".join(f"bp.{c} AS baseline_{c}" for c in _PLACED)}, round(CASE WHEN bp.at_clause_onset > 0 THEN m.at_clause_onset / bp.at_clause_onset ELSE 0.0 END, 9) AS lift, {_AT} FROM m JOIN bp USING (asked_level) WHERE asked_level = 2""",
    "system_fidelity": f"""{_W3}, g AS (SELECT {_NAME}, asked_level, count(*) AS sentences, CAST(sum(len(a)) AS BIGINT) AS clean_words, CAST(sum(dropped) AS BIGINT) AS dropped, count(*) FILTER (dropped > 0) AS sentences_with_drop FROM pairs JOIN lost USING (utt_id) GROUP BY ALL)
SELECT *, 1 - dropped / CAST(clean_words AS DOUBLE) AS kept, sentences_with_drop / CAST(sentences AS DOUBLE) AS share_with_drop, {_AT} FROM g""",
    "system_copy_failure": f"""{_W3}, {UNI_SQL}, {_D}, u AS (SELECT DISTINCT utt_id FROM (SELECT utt_id, {NORM("word")} AS nw FROM wd) x WHERE nw <> '' AND nw NOT IN (SELECT word FROM uni WHERE n >= 2)),
m AS (SELECT {_NAME}, u.utt_id IS NOT NULL AS has_unseen, len(a) AS n_clean, dropped, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("n_events", "inserted", *[f"n_{t}" for t in L.TYPES]))}
  FROM pairs JOIN lost USING (utt_id) LEFT JOIN d USING (utt_id) LEFT JOIN u ON u.utt_id = pairs.utt_id // 3 WHERE asked_level = 2),
g AS (SELECT system, has_unseen, {SUMS_SQL}, CAST(sum(dropped) AS BIGINT) AS dropped FROM m GROUP BY ALL), r AS ({rates_sql("g", "system, has_unseen, dropped,")})
SELECT *, 1 - dropped / CAST(clean_words AS DOUBLE) AS kept FROM r""",
    "system_round_trip": f"""{_W2.replace("WITH", "WITH RECURSIVE", 1)}, p AS (SELECT 'injector' AS system, asked_level, array_to_string(clean_tokens, ' ') AS a, array_to_string(disfluent_tokens, ' ') AS b FROM utt_r
UNION ALL SELECT 'corpus', NULL, array_to_string(clean_tokens, ' '), array_to_string(list_transform(list_sort(list_filter(alignment, lambda x: x IS NOT NULL)), lambda j: clean_tokens[j + 1]), ' ') FROM utt
UNION ALL SELECT 'lossy', asked_level, array_to_string(clean_tokens, ' '), array_to_string(clean_tokens[1 : len(clean_tokens) - 1], ' ') FROM scripts
UNION ALL SELECT 'swapped', asked_level, array_to_string(clean_tokens, ' '), array_to_string([clean_tokens[2], clean_tokens[1], clean_tokens[3], 'other'] || clean_tokens[5 : len(clean_tokens)], ' ') FROM scripts), {_RECOVERED},
wl AS (SELECT *, row_number() OVER () AS id, string_split(x, ' ') AS xs, string_split(y, ' ') AS ys FROM w),
dp AS (
  SELECT id, CAST(0 AS BIGINT) AS i, CAST(r.j AS BIGINT) AS j, CAST(r.j AS BIGINT) AS v FROM wl, range(200) r(j) WHERE x <> y AND r.j <= len(ys)
  UNION ALL
  SELECT id, i, j, CAST(j + min(best - j) OVER (PARTITION BY id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) FROM (
    SELECT id, i + 1 AS i, j, CASE WHEN j = 0 THEN v + 1 ELSE least(v + 1, lag(v) OVER (PARTITION BY id ORDER BY j) + CASE WHEN xs[i + 1] = ys[j] THEN 0 ELSE 1 END) END AS best FROM dp JOIN (SELECT id, xs, ys FROM wl) USING (id) WHERE i < len(xs))),
ed AS (SELECT id, v AS edits FROM dp JOIN (SELECT id, xs, ys FROM wl) USING (id) WHERE i = len(xs) AND j = len(ys)),
g AS (SELECT system, asked_level, count(*) AS n, avg(CAST(exact AS INTEGER)) AS exact_match, avg(CAST(x = y AS INTEGER)) AS words_only_match, sum(coalesce(edits, 0)) / CAST(sum(len(xs)) AS DOUBLE) AS wer_words_only FROM wl LEFT JOIN ed USING (id) GROUP BY ALL)
SELECT *, {_AT} FROM g""",
    "detector_confusion_ordered": f"{W.replace('WITH', 'WITH RECURSIVE', 1)}, {PAIRS_SQL}, {DETECT_SQL}, {CONFUSION_SQL} SELECT gold, found, n, CAST(row_number() OVER (ORDER BY n DESC, gold, found) AS INTEGER) AS place FROM cells",
    "detector_report": f"""{W.replace('WITH', 'WITH RECURSIVE', 1)}, {PAIRS_SQL}, {DETECT_SQL}, {_D} SELECT count(*) AS utterances, count(*) FILTER (dropped > 0) AS utterances_with_drop,
{", ".join(f"CAST(sum(ms.n_{t}) AS BIGINT) AS gold_{t}, CAST(sum(coalesce(d.n_{t}, 0)) AS BIGINT) AS detected_{t}" for t in L.TYPES)} FROM ms JOIN lost USING (utt_id) LEFT JOIN d USING (utt_id)""",
}
