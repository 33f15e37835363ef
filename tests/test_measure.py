import pytest
from pyspark.sql import functions as F

from disfluo import schemas
from disfluo.operators import evaluate, measure, ordering


def utterance(i, n, types):
    k = len(types)
    notes = [{"type": t, "reparandum": None if t == "filler" else {"start": j, "end": j + 1}, "interregnum": {"start": j, "end": j + 1} if t == "filler" else None, "repair": None if t == "filler" else {"start": j + 1, "end": j + 2}} for j, t in enumerate(types)]
    words = [f"w{j}" for j in range(n)]
    return {"utt_id": i, "doc_id": i, "asked_level": 0, "clean": " ".join(words), "clean_tokens": words, "n_clean": n, "disfluent_tokens": ["uh"] * k + words, "alignment": [None] * k + list(range(n)), "annotations": notes}


SCHEMA = schemas.T.StructType([schemas.T.StructField(n, t) for n, t in (("utt_id", schemas.T.LongType()), ("doc_id", schemas.T.LongType()), ("asked_level", schemas.T.IntegerType()), ("clean", schemas.T.StringType()), ("clean_tokens", schemas.WORDS), ("n_clean", schemas.T.IntegerType()), ("disfluent_tokens", schemas.WORDS), ("alignment", schemas.T.ArrayType(schemas.T.IntegerType())), ("annotations", schemas.T.ArrayType(schemas.ANNOTATION)))])


@pytest.fixture(scope="module")
def corpus(spark):
    kinds = [[], ["filler"], ["filler", "repetition", "repair"], ["filler"] * 8]
    rows = [utterance(20 * k + j, 20, kind) for k, kind in enumerate(kinds) for j in range(20)] + [utterance(99, 9, ["filler"])]
    return spark.createDataFrame(rows, SCHEMA)


def test_levels_partition_the_pool(corpus):
    table = {r["level"]: r for r in measure.level_table(measure.measure(corpus)).collect()}
    assert sorted(table) == [0, 1, 2, 3] and sum(r["utterances"] for r in table.values()) == 80
    assert [table[k]["utterances"] for k in range(4)] == [20, 20, 20, 20]
    assert table[1]["total_rate"] == 5 and table[3]["rate_filler"] == 40 and table[0]["words_per_event"] == float("inf")


def test_cut_edges_keep_their_level(spark):
    rows = spark.createDataFrame([utterance(1, 14, ["filler"] * 3), utterance(2, 28, ["filler"] * 6)], SCHEMA)
    cuts = spark.createDataFrame([(10.0, 21.42857142857143)], "light double, heavy double")
    assert {r["level"] for r in measure.with_level(measure.measure(rows), cuts).collect()} == {3}


def test_empty_corpus(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert measure.percentile_cuts(measure.measure(none)).first().asDict() == {"light": 0.0, "heavy": 0.0}
    assert measure.level_table(measure.measure(none)).count() == 4
    assert measure.unigrams(none).count() == 0


def test_unknown_types_count_as_inserted_words_only(spark):
    row = utterance(1, 10, ["filler", "laugh"])
    m = measure.measure(spark.createDataFrame([row], SCHEMA)).first()
    assert (m["n_events"], m["inserted"]) == (1, 2)


def test_divergence(spark):
    cols = [f"mix_{t}" for t in ("filler", "repetition", "repair", "false_start")]
    even = spark.createDataFrame([(0.25, 0.25, 0.25, 0.25)], cols)
    one = spark.createDataFrame([(1.0, 0.0, 0.0, 0.0)], cols)
    kl = lambda a, b: evaluate.mix_divergence(a, b).first()["kl_bits"]
    assert abs(kl(even, even)) < 1e-12 and abs(kl(one, even) - 2) < 0.01 and 0 < kl(even, one) < 100


def test_recovery_counts_edits_over_all_words(spark):
    rows = [("Send it now.", "send it now"), ("a b c d", "a x c d e"), ("!", "?")]
    r = evaluate.recovery(spark.createDataFrame(rows, "original string, recovered string")).first()
    assert r["n"] == 3 and r["words_only_match"] == pytest.approx(2 / 3) and r["wer_words_only"] == pytest.approx(2 / 8) and r["exact_match"] == pytest.approx(1 / 3)


def test_running_totals_and_splits(spark):
    df = spark.range(3000).withColumn("h", ordering.seeded("s", "id")).withColumn("n", (F.col("id") % 7).cast("long"))
    got = {r["h"]: r["t"] for r in ordering.running_total(df, "h", F.col("n"), "t", 3_000_000).collect()}
    total = 0
    for r in sorted(df.collect(), key=lambda r: r["h"]):
        assert got[r["h"]] == total
        total += r["n"]
    sizes = spark.createDataFrame([(i, 10) for i in range(20)], "conv_id long, n long")
    by = {r["split"]: r["c"] for r in ordering.split_by_conversation(sizes).groupBy("split").agg(F.count("*").alias("c")).collect()}
    assert by == {"eval": 5, "val": 1, "train": 14}


def test_bootstrap_brackets_the_mean(spark):
    rows = [(i, 0, p, float((i * 37) % 11) + p, 1.0) for i in range(200) for p in (-1, 0, 1)]
    got = evaluate.bootstrap(spark.createDataFrame(rows, "utt_id long, k int, pos int, data double, control double"), draws=200).collect()
    assert len(got) == 3 and all(r["low"] < r["mean_effect"] < r["high"] and r["n"] == 200 for r in got)
