"""What large tables pay for: how often rows are read and words are cut, and results of the quicker steps beside plain ones."""

import random

from pyspark.sql import functions as F

from disfluo.functions import text as X
from disfluo.operators import corpus, detect, evaluate, models
from disfluo.plans import systems
from disfluo.sources import io


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def counting(spark, df, column):
    """df with a column that counts each row that is worked out."""
    seen = spark.sparkContext.accumulator(0)

    def add(x):
        seen.add(1)
        return x

    kind = dict(df.dtypes)[column]
    return df.withColumn(column, F.udf(add, kind).asNondeterministic()(column)), seen


def test_words_of_a_script_are_cut_once(spark, sf):
    assert plan(corpus.scripts(spark, sf)).count("split(") == 2  # into sentences, and each into words


def test_only_words_with_events_are_worked_out(spark, sf):
    assert "heads" not in plan(corpus.spoken(corpus.scripts(spark, sf)))


def test_the_detector_sees_the_systems_asked_for_alone(spark, sf):
    one = systems.detected(spark, sf, "corpus")
    assert "Union" not in plan(one) and {r["system"] for r in one.select("system").distinct().collect()} == {"corpus"}


def test_a_chain_reads_utterances_once(spark, sf):
    said = corpus.spoken(corpus.scripts(spark, sf)).limit(300).persist()
    counted, seen = counting(spark, said, "utt_id")
    chain = models.learn_chain(counted.withColumn("asked_level", F.when(F.col("utt_id") >= 0, F.col("asked_level"))))
    assert seen.value == 300 and chain.steps and chain.phrases
    said.unpersist()


def test_many_bigrams_are_counted_once(spark):
    own = spark.createDataFrame([(f"w{k % 7} w{k % 11} w{k % 3}",) for k in range(60)], "text string").repartition(2)
    counted, seen = counting(spark, own, "text")
    scorer = models.Bigrams(models.bigram_counts(counted), most=5)
    assert not scorer.small and scorer.score(own).count() == 60 and seen.value == 60


def test_copies_of_a_sentence_are_dealt_to_many_chunks(spark):
    own = spark.createDataFrame([(k, "a b c") for k in range(400)] + [(-1, None), (-2, "z q")], "id long, text string")
    scorer = models.Bigrams(models.bigram_counts(own.select("text")), most=0)
    out = scorer.joined(own.withColumn("bits", F.lit(None).cast("string")).drop("bits"))
    rows = out.withColumn("part", F.spark_partition_id()).collect()
    assert len(rows) == 402 and sum(r["bits"] is None for r in rows) == 1
    assert len({tuple(r["bits"]) for r in rows if r["text"] == "a b c"}) == 1


def test_sums_by_word_beside_plain_ones(spark):
    rng = random.Random(5)
    rows = []
    for k in range(60):
        text = "".join(rng.choice("ab  ") for _ in range(rng.randrange(30)))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text), 6)))
        pieces = [(a, b, None if rng.random() < 0.1 else float(rng.randrange(9))) for a, b in zip(cuts, cuts[1:])]
        rows.append((k, text, pieces))
    df = spark.createDataFrame([*rows, (99, None, [(0, 1, 1.0)]), (98, "a b", [])], "id long, text string, pieces array<struct<start:int,end:int,bits:double>>")
    got = {r["id"]: r["bits"] for r in X.fold_to_words(df, "text", "pieces").collect()}
    assert got[99] is None and got[98] == [0.0, 0.0]
    for k, text, pieces in rows:
        starts = [i for i, c in enumerate(text) if c != " " and (i == 0 or text[i - 1] == " ")]
        want = [0.0] * len(starts)
        for a, b, bits in pieces:
            inner = text[a:b].lstrip(" ")
            word = sum(s <= b - len(inner) for s in starts) - 1
            if inner and word >= 0:
                want[word] = None if bits is None or want[word] is None else want[word] + bits
        assert got[k] == want, (text, pieces)
    assert "aggregate(_placed" not in plan(X.fold_to_words(df, "text", "pieces")) and "_summed" in dir(X)


def test_windows_score_a_sentence_once(spark, sf):
    calls = []

    def score(sentences):
        calls.append(1)
        counted, seen = counting(spark, sentences, "text")
        calls.append((seen, sentences.count()))
        return counted.withColumn("bits", F.transform(F.split("text", " "), lambda w: F.length(w).cast("double")))

    assert evaluate.scored_windows(corpus.spoken(corpus.scripts(spark, sf)), score).count() > 0
    seen, n = calls[1]
    assert seen.value == n


def test_pairs_at_the_same_places_are_assigned_alike(spark):
    kinds = ["filler", "repair", "repetition"]
    rng = random.Random(3)
    events = lambda: [(rng.choice(kinds), x) for x in sorted(rng.choices(range(6), k=rng.randrange(4)))]
    rows = []
    for _ in range(200):
        g = events()
        rows.append((g, [(rng.choice(kinds), x) for _, x in g] if rng.random() < 0.6 else events()))
    df = spark.createDataFrame(rows, "g array<struct<type:string,start:int>>, f array<struct<type:string,start:int>>")
    for r in df.select("g", "f", detect.assigned("g", "f").alias("p")).collect():
        free, want = list(r["g"]), []
        for f in r["f"]:
            near = [g for g in free if abs(g["start"] - f["start"]) <= 1]
            best = min(near, key=lambda g: abs(g["start"] - f["start"])) if near else None
            want.append((best["type"] if best else "none", f["type"]))
            if best:
                del free[next(k for k, g in enumerate(free) if g is best)]
        assert sorted(map(tuple, r["p"])) == sorted(want + [(g["type"], "none") for g in free])


def test_a_place_is_worked_out_when_it_is_reached(spark, sf):
    from disfluo.operators import inject
    from disfluo.plans.evaluation import RULES

    shown = plan(inject.spoken_by_rules(corpus.scripts(spark, sf), RULES))
    assert "_found" not in shown  # before, an array of all candidates


def test_sentences_are_read_and_detokenised_once(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("text is not null").select("doc_id", "text")
    assert plan(io.usable_sentences(docs, "doc_id")).count("translate(") == 1  # before, once for each test
    counted, seen = counting(spark, docs, "text")
    monkeypatch.setattr(io, "_or_empty", lambda spark, read, schema: counted)
    rows = io.sentence_source(spark, ["documents"], 60).collect()
    assert len(rows) > 42 and seen.value == docs.count()  # before, four times as many
