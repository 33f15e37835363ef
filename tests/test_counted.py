"""Counts without the words, and draws from the rows that can be drawn: beside the whole work."""

import random

from pyspark.sql import functions as F

from disfluo.functions import lexicon as L
from disfluo.functions.text import canonical_tokens, spoken_form
from disfluo.operators import corpus, detect, inject, measure, pools
from disfluo.plans import systems
from disfluo.plans.evaluation import RULES

WORDS = "Monday, two 17 0 report; uh well 'so' the and of walked quietly «green» İab ÉTÉ harbour: north (south) like, x1 123456789012345678".split()


def test_events_counted_are_those_injected(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(13))) for _ in range(300)] + [None, "", "uh uh uh", "one two three four five six seven"]
    rows = [(k, t, k % 3 + 1) for k, t in enumerate(texts)] + [(None, "Carry both green boxes upstairs after lunch.", 2)]
    df = spark.createDataFrame(rows, "utt_id long, clean string, asked_level int").withColumn("doc_id", F.lit(0).cast("long"))
    words = F.coalesce(canonical_tokens(F.col("clean")), F.array().cast("array<string>"))
    traits = inject.traits(df.withColumn("clean_tokens", words).withColumn("n_clean", F.size("clean_tokens")))
    for dial in (RULES, {1: inject.Rates(40, 30, 20, 30), 2: inject.Rates(90, 0, 60, 0), 3: inject.Rates(5, 60, 30, 40)}):
        want = inject.spoken_by_rules(df, dial).select("utt_id", F.size("annotations").alias("n")).collect()
        got = inject.counted(traits, dial).select("utt_id", "n_events").collect()
        assert sorted((str(r[0]), r[1]) for r in got) == sorted((str(r[0]), r[1]) for r in want)


def test_events_of_the_corpus_are_counted_without_words(spark, sf):
    s = corpus.scripts(spark, sf)
    want = measure.measure(corpus.spoken(s)).select("utt_id", "n_events", "rate").collect()
    assert sorted(measure.rated(corpus.counted(s)).select("utt_id", "n_events", "rate").collect()) == sorted(want)
    assert measure.percentile_cuts(measure.rated(corpus.counted(s))).first() == measure.percentile_cuts(measure.measure(corpus.spoken(s))).first()


def plainly(rows, seed, each):
    """The draw by sorting all rows."""
    import hashlib

    key = lambda r: (hashlib.md5(f"{seed}:{r[0]}".encode()).hexdigest(), r[0])
    levels = [r[2] for r in rows]
    taken, out = set(), []
    for level in sorted(set(levels), key=lambda k: (levels.count(k), k)):
        mine = []
        for r in sorted((r for r in rows if r[2] == level), key=key):
            if r[1] not in taken and r[1] not in {x[1] for x in mine} and len(mine) < each:
                mine.append(r)
        taken |= {r[1] for r in mine}
        out += mine
    return sorted(out)


def test_a_bounded_draw_is_the_whole_one(spark):
    rng = random.Random(8)
    for copies in (1, 40):  # with many rows of one sentence the bounds have to be raised
        rows = [(k, rng.randrange(3) if rng.random() < 0.9 and copies > 1 else k // 4, min(3, int(rng.expovariate(0.9)))) for k in range(1500)]
        df = spark.createDataFrame(rows, "utt_id long, sentence long, level int")
        for ahead in (1, 64):
            got = pools.balanced(df, "sentence", "7", 12, ahead).select("utt_id", "sentence", "level").collect()
            assert sorted(map(tuple, got)) == plainly(rows, "7", 12)


def test_rows_far_off_are_not_put_in_order(spark):
    df = spark.range(40000).select(F.col("id").alias("utt_id"), F.col("id").alias("sentence"), (F.col("id") % 4).cast("int").alias("level"))
    out = pools.balanced(df, "sentence", "7", 5)
    assert "h#" in out._jdf.queryExecution().optimizedPlan().toString() and out.count() == 20  # before, all 40,000 were grouped by sentence, level by level


def test_a_script_holds_no_white_space_but_the_space(spark, tmp_path):
    text = "The boxes stand in the hall.\r\nand so.\nNobody came to fetch them yet.\nThey are - so they say - quite heavy.  \n  It is late, and the lights are out!\nA word . stands alone here today.\nHer «own» key fits no door here."
    spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    said = [r["clean"] for r in corpus.scripts(spark, str(tmp_path)).orderBy("utt_id").collect()]
    assert said == ["Nobody came to fetch them yet.", "It is late, and the lights are out!"]  # before, the first line too, with its \r


def test_pairs_are_counted_as_they_are_detected(spark):
    rng = random.Random(6)
    words = "uh um you know i mean no wait sorry what can we carry both green boxes upstairs".split()
    rows = [(0, "", ""), (1, "a b c", ""), (2, "", "uh"), (3, "a b a b", "a b"), (4, "a b c", "a b c"), (5, "a a b", "a b")]
    for k in range(400):
        clean = [rng.choice(words) for _ in range(rng.randrange(12))]
        said = [w for c in clean for w in [*rng.choices(words, k=rng.choice((0, 0, 0, 1, 2, 4))), *([c] if rng.random() < 0.9 else [])]]
        rows.append((10 + k, " ".join(clean), " ".join(said if k % 4 else clean[: rng.randrange(13)])))
    df = spark.createDataFrame(rows, "utt_id long, clean string, spoken string").withColumns({"doc_id": F.lit(0).cast("long"), "asked_level": F.lit(2)})
    found = detect.detected(df)
    names = [f"n_{t}" for t in L.TYPES] + ["inserted", "n_events"]
    whole = measure.measure(found.withColumn("n_clean", F.size("clean_tokens")).withColumn("lost", F.size("dropped").cast("long")), "lost")
    lean = detect.counted(found.select("utt_id", F.transform("clean_tokens", spoken_form).alias("own"), "disfluent_tokens"))
    cols = ["utt_id", "n_clean", *names, "lost"]
    assert lean.select(cols).orderBy("utt_id").collect() == whole.select(cols).orderBy("utt_id").collect()
    assert lean.select(names).dtypes == whole.select(names).dtypes


def test_copy_failure_detects_a_pair_of_its_level_once(spark, sf, monkeypatch):
    seen, whole = spark.sparkContext.accumulator(0), detect._count_rows

    def rows(clean, out):
        seen.add(len(clean))
        return whole(clean, out)

    monkeypatch.setattr(detect, "count_udf", F.arrow_udf(rows, detect.COUNTED).asNondeterministic())
    assert len(systems.system_copy_failure(spark, sf).collect()) == 6
    n = corpus.scripts(spark, sf).filter("asked_level = 2").count()
    assert seen.value == 3 * n  # before, all four levels' pairs, twice
    assert sorted(corpus.scripts(spark, sf, 2).collect()) == sorted(corpus.scripts(spark, sf).filter("asked_level = 2").collect())
