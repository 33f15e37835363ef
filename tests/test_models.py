"""Models that a task loads once: loads counted, batches by length, bits against plain sums, and speech that no partitioning changes."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from disfluo.operators import corpus, evaluate, models, systems


class Counting:
    """Answers with the sizes of the batch that a text came in, and counts loads."""

    def __init__(self, loads):
        loads.add(1)

    def answers(self, inputs):
        return [f"{len(inputs)}:{max(t[0].count(' ') + 1 for t in inputs)}" for _ in inputs]


def test_one_load_for_each_task_and_batches_by_length(spark):
    loads = spark.sparkContext.accumulator(0)
    rows = [(" ".join("w" * (1 + k % 7) + str(k % 20)[-1] for _ in range(1 + k % 20)),) for k in range(4000)]
    df = spark.createDataFrame(rows, "text string").repartition(3)
    conf, name = spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = conf.get(name)
    conf.set(name, "100")  # many Arrow batches in a task
    try:
        got = df.select(models.loaded(lambda: Counting(loads), "string", rows=8, words=64)(F.col("text")).alias("a"), "text").collect()
    finally:
        conf.set(name, was)
    assert loads.value == 3 and len(got) == 4000
    for r in got:
        size, longest = map(int, r["a"].split(":"))
        assert size <= 8 and (size == 1 or size * longest <= 64)


def test_batches_hold_each_distinct_input_once():
    inputs = [("a b c",), ("a",), ("a b c",), ("",), ("b c",), (" ".join("x" * 50),)]
    got = list(models.in_batches(inputs, rows=2, words=6))
    assert [t for b in got for t in b] == [("",), ("a",), ("b c",), ("a b c",), (" ".join("x" * 50),)] and [len(b) for b in got] == [2, 2, 1]


def plain_bits(sentences, text):
    """The bits of a text's words by dictionaries."""
    keys = lambda t: [w.lower().strip(".,!?;:'\"") for w in t.split(" ")]
    pairs = Counter(p for s in sentences for p in zip([models.START, *keys(s)], keys(s)))
    own, times, after = Counter(), Counter(), Counter()
    for (a, b), n in pairs.items():
        own[b] += n
        times[a] += n
        after[a] += 1
    p1 = lambda w: (own[w] + 1 / (len(own) + 1)) / (sum(own.values()) + 1)
    return [-math.log2((pairs[a, b] + after[a] * p1(b)) / (times[a] + after[a]) if times[a] else p1(b)) for a, b in zip([models.START, *keys(text)], keys(text))]


def test_bits_by_plain_sums_on_both_ways(spark):
    own = ["The cat sat.", "the cat ran", "A dog ran, ran", "the cat sat."]
    counts = models.bigram_counts(spark.createDataFrame([(s,) for s in [*own, None]], "text string")).cache()
    asked = [*own, "the bird sat", "zebra", "", "cat cat cat", "ran a", None, "the bird sat"]
    texts = spark.createDataFrame([(s,) for s in asked], "text string").repartition(3)
    few, many = models.Bigrams(counts), models.Bigrams(counts, most=3)
    assert few.small and not many.small
    for scorer in (few, many):
        got = scorer.score(texts).collect()
        assert len(got) == len(asked)
        for r in got:
            assert r["bits"] is None if r["text"] is None else r["bits"] == pytest.approx(plain_bits(own, r["text"]))
    seen = [models.START, *{w for s in own for w in plain_words(s)}]
    table = models.PackedBigrams(*zip(*[(r["before"], r["word"], r["n"]) for r in counts.collect()]))
    for before in seen:  # the words after each known one, with one unknown word, share all that there is
        texts = [f"{before} {w}" if before != models.START else w for w in [*seen[1:], "never"]]
        assert sum(2 ** -a[-1] for a in table.answers([(t,) for t in texts])) == pytest.approx(1)


def plain_words(s):
    return [w.lower().strip(".,") for w in s.split(" ")]


def test_nothing_to_count(spark):
    none = models.bigram_counts(spark.createDataFrame([], "text string"))
    texts = spark.createDataFrame([("a b",), ("",)], "text string")
    for most in (10, -1):
        scorer = models.Bigrams(none, most=max(most, 0))
        assert sorted(list(r["bits"]) for r in (scorer.score(texts) if most > 0 else scorer.joined(texts)).collect()) == [[0.0], [0.0, 0.0]]


def test_speech_is_the_same_at_any_partitioning(spark, sf):
    s = corpus.scripts(spark, sf)
    said = models.markov(corpus.spoken(s))
    columns = lambda df: {r["utt_id"]: r["spoken"] for r in df.select("utt_id", "spoken").collect()}
    one, many = columns(said.speak(s.repartition(1))), columns(said.speak(s.repartition(17)))
    assert one == many and len(one) > 100
    assert columns(models.Loaded(said.load, 13, rows=3).speak(s)) == one and columns(models.Loaded(said.load, 14).speak(s)) != one


def test_chain_repeats_what_it_learned(spark):
    chain = models.Chain({("1", "none", "1"): (["filler", "none"], [1, 2]), ("1", "filler", "0"): (["repetition"], [5])}, {"filler": (["uh", "you know"], [3, 4])})
    got = Counter(chain.say("we go", "10", "1", str(k)) for k in range(2000))
    # after no event the next state was never seen, so nothing goes there; after a filler the next word always repeats
    assert set(got) == {"we go", "uh we go go", "you know we go go"} and 850 < got["we go"] < 1150 and got["uh we go go"] > 2 * got["you know we go go"]
    assert chain.say("", "", "1", "x") == "" and chain.say("we go", "10", "3", "x") == "we go"


def test_odd_scripts_and_utterances(spark):
    rows = [(None, None, 1), (1, "", 2), (2, None, None), (2, "Well, so be it.", 9), (3, "Well, so be it.", 1), (3, "Well, so be it.", 1)]
    odd = spark.createDataFrame(rows, "utt_id long, clean string, asked_level int")
    empty = corpus.spoken(corpus.scripts(spark, "/root/testdata/sf0.001").limit(0))
    got = models.markov(empty).speak(odd).collect()  # learned from nothing: nothing is added
    assert sorted(r["spoken"] for r in got) == ["", "", "", *["well so be it"] * 3]


def test_protocol_of_a_generator_and_a_scorer(spark, sf):
    said = corpus.spoken(corpus.scripts(spark, sf))
    assert hasattr(models.markov(said), "speak") and hasattr(systems.Generator, "speak")
    scorer = models.Bigrams(models.bigram_counts(said.select(F.array_join("clean_tokens", " ").alias("text"))))
    w = evaluate.scored_windows(said, scorer.score)
    both = evaluate.scored_windows(said, scorer.joined)
    shown = lambda df: sorted((r["utt_id"], r["k"], r["pos"], round(r["data"], 9), round(r["control"], 9)) for r in df.collect())
    assert shown(w) == shown(both) and w.count() > 0
