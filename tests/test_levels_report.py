"""Level settings, generators by name, reports and their order, mixing of real pairs, and training rows."""

import math
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from disfluo.functions import text as X
from disfluo.functions.report import markdown, qualitative
from disfluo.functions.templates import TEMPLATES, VALUES
from disfluo.operators import evaluate, levels, pools, report, systems
from disfluo.operators.inject import Rates
from disfluo.sources import io

SPEC = {"levels": [{"level": k, "total_rate": 5.0 * k, **{f"rate_{t}": 1.25 * k for t in levels.L.TYPES}, **{f"mix_{t}": 0.25 for t in levels.L.TYPES}} for k in range(4)]}


def test_settings_of_a_level():
    assert levels.targets(SPEC, 2)["total"] == 10 and levels.mix(SPEC, 1)["repair"] == 0.25
    assert levels.rates(SPEC, 3) == Rates(3.75, 3.75, 3.75, 3.75) and levels.rates(SPEC, 3, repair=0.0).repair == 0
    assert sorted(levels.dial(SPEC)) == [1, 2, 3] and levels.describe(SPEC).splitlines()[2] == "<d2>  10.00 events per 100 words, one in 10 words"
    for bad in (-1, 4, "2"):
        with pytest.raises(ValueError, match="a level is one of"):
            levels.check(bad)


def test_generators_by_name(tmp_path):
    assert isinstance(systems.resolve("rules", {}), systems.Rules)
    with pytest.raises(ValueError, match="no generator named"):
        systems.resolve("oracle", {})
    with pytest.raises(FileNotFoundError, match="no model at"):
        systems.resolve("model", {}, path=str(tmp_path / "none"))
    assert systems.resolve("model", {}, path=str(tmp_path), load=lambda p: p) == str(tmp_path)
    assert [systems.looks_local(p) for p in ("./m", "/m", "~/m", "outputs/m", "someone/m", "")] == [True, True, True, True, False, False]


def test_order_of_systems_and_levels(spark):
    rows = [("corpus", None), ("injector", 2), ("model greedy", 0), ("model", 1), ("injector", None), ("zeta", 0), ("alpha", 3), ("injector", 0)]
    got = report.placed(spark.createDataFrame(rows, "system string, asked_level int")).orderBy("place").collect()
    assert [(r["system"], r["asked_level"]) for r in got] == [("model", 1), ("model greedy", 0), ("injector", 0), ("injector", 2), ("injector", None), ("corpus", None), ("alpha", 3), ("zeta", 0)]
    cells = spark.createDataFrame([("a", "b", 2), ("a", "a", 9), ("b", "b", 2)], "gold string, found string, n long")
    assert [(r["gold"], r["found"]) for r in report.by_count(cells).orderBy("place").collect()] == [("a", "a"), ("a", "b"), ("b", "b")]


def test_reports_are_written_patched_and_never_cut(spark, tmp_path):
    path = str(tmp_path / "r")
    io.write_report({"one": spark.createDataFrame([(1, 0.5)], "a int, b double")}, path)
    io.patch_report(spark.createDataFrame([("x",)], "c string"), "two", path)
    assert io.read_report(spark, path) == {"one": [{"a": 1, "b": 0.5}], "two": [{"c": "x"}]}
    assert "| 1 | 0.500 |" in "\n".join(r[0] for r in spark.read.text(path + ".md").collect())
    with pytest.raises(ValueError, match="at most 3 rows"):
        markdown(spark.range(4), ["id"], most=3)
    said = spark.createDataFrame([(1, "It rains.", 0, "it rains"), (1, "It rains.", 1, "uh it rains"), (2, "So?", 0, "so")], "utt_id long, clean string, asked_level int, spoken string")
    assert qualitative(said).splitlines() == ["**1.** `It rains.`", "", "    d0  it rains", "    d1  uh it rains", "", "**2.** `So?`", "", "    d0  so"]


def test_required_frequencies(spark, tmp_path):
    with pytest.raises(AnalysisException):
        io.read_frequencies(spark, str(tmp_path / "none"), required=True)


def test_real_pairs_in_the_mix(spark):
    synthetic, real = spark.range(5).withColumnRenamed("id", "utt_id"), spark.range(10, 20).withColumnRenamed("id", "utt_id")
    count = lambda n: {r["source"]: r["n"] for r in io.mix_real(synthetic, real, n).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert count(0) == {"synthetic": 5} and count(4) == {"synthetic": 5, "real": 4} and count(-1) == {"synthetic": 5, "real": 10}
    order = [r["utt_id"] for r in io.mix_real(synthetic, real, -1).orderBy("h").collect()]
    assert order != sorted(order)


def test_balanced_draw(spark):
    rows = [(4 * s + k, s, min(k, s % 3)) for s in range(40) for k in range(4)]  # no sentence reaches level 3, few reach 2
    got = pools.balanced(spark.createDataFrame(rows, "utt_id long, sentence long, level int"), "sentence", "7", 10).collect()
    assert {k: sum(r["level"] == k for r in got) for k in range(4)} == {0: 10, 1: 10, 2: 10, 3: 0} and len({r["sentence"] for r in got}) == 30


def test_template_slots_are_all_known():
    used = {x.rstrip("2") for t in TEMPLATES for x in __import__("re").findall(r"\{(\w+)\}", t)}
    assert used == set(VALUES) and len(TEMPLATES) == 38 and len(VALUES) == 17


def test_pieces_fold_into_words(spark):
    df = spark.createDataFrame([("ab  cd e", [(0, 1, 1.0), (1, 2, 2.0), (2, 5, 4.0), (5, 6, 8.0), (6, 8, 16.0), (2, 4, 32.0)])], "text string, pieces array<struct<start:int,end:int,bits:double>>")
    assert X.fold_to_words(df, "text", "pieces").first()["bits"] == [3.0, 12.0, 16.0]  # a piece of spaces counts nowhere
    bits = spark.range(1).select(X.surprisal_bits(F.array(F.lit(1.0), F.lit(2.0), F.lit(1000.0)), F.lit(1)).alias("b"), X.surprisal_bits(F.array(F.lit(3.0), F.lit(3.0)), F.lit(0)).alias("c")).first()
    assert bits["b"] == pytest.approx(998 / math.log(2)) and bits["c"] == pytest.approx(1.0)


def test_effect_summary(spark):
    rows = [(-1, 7, 2.0, 1.0, 3.0), (0, 7, 1.5, 1.0, 2.0), (1, 7, -2.0, -3.0, -1.0)]
    r = evaluate.effect_summary(spark.createDataFrame(rows, "pos int, n long, mean_effect double, low double, high double")).first()
    assert (r["n"], r["peak_position"], r["peak_effect"], r["peak_low"], r["effect_at_boundary"], r["boundary_high"]) == (7, -1, 2.0, 1.0, 1.5, 2.0)
    none = evaluate.effect_summary(spark.createDataFrame([], "pos int, n long, mean_effect double")).first()
    assert none["n"] == 0 and none["peak_position"] is None


def test_training_rows_and_tokens(spark):
    pairs = spark.createDataFrame([("Go home.", "uh go home", 2), (None, "x", 1), ("So?", None, 0)], "clean string, disfluent string, level int")
    rows = io.training_rows(pairs)
    assert [tuple(r) for r in rows.collect()] == [("<d2> say aloud: Go home.", "uh go home", 2)]
    path = "/opt/tokenizers/byte_bpe_50k.json"
    if os.path.exists(path):
        r = io.tokenised(rows, path, max_source=4).first()
        assert len(r["input_ids"]) == 4 and len(r["labels"]) >= 3 and r["input_ids"][0] not in r["labels"]
