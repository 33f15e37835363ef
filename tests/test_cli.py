"""The command lines, one after another, as a user would run them."""

import io as streams
import json

import pytest
from pyspark.sql import functions as F

from disfluo.__main__ import main
from disfluo.operators import corpus
from disfluo.plans.sources import utterances
from disfluo.sources import io


def test_speak(spark, capsys, tmp_path, monkeypatch):
    assert main(["--level", "3", "--trace", "--dump", str(tmp_path / "g"), "Phone the studio before noon,", "and ask for Nina or the manager of the week."]) == 0
    out = capsys.readouterr().out
    assert "| type |" in out and io.read_generations(spark, str(tmp_path / "g")).count() == 1
    assert main(["--all-levels", "It rains."]) == 0
    assert capsys.readouterr().out.splitlines()[0] == "<d0> it rains"
    monkeypatch.setattr("sys.stdin", streams.StringIO("\n  \n"))
    assert main([]) == 1
    with pytest.raises(SystemExit):
        main(["--level", "4", "It rains."])
    with pytest.raises(FileNotFoundError):
        main(["--system", "model", "--model", "./none", "It rains."])


def test_corpus_to_evaluation(spark, sf, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    marked = corpus.markup(corpus.scripts(spark, sf).limit(600))
    marked.select("text", F.expr("utt_id % 20").cast("string").alias("conversation_no")).write.option("header", True).option("escape", '"').csv(at("csv"))
    assert main(["corpus", "--root", at("csv"), "--out", at("corpus"), "--split"]) == 0
    parts = [io.read_jsonl(spark, at(f"corpus.{x}")) for x in ("train", "val", "eval")]
    whole = io.read_jsonl(spark, at("corpus"))
    assert sum(p.count() for p in parts) == whole.count() > 500 and not {r[0] for r in parts[0].select("conversation").collect()} & {r[0] for r in parts[2].select("conversation").collect()}
    assert main(["rates", "--data", at("corpus"), "--out", at("levels"), "--frequencies", at("words")]) == 0
    assert main(["levels", "--spec", at("levels")]) == 0 and "<d3>" in capsys.readouterr().out
    assert main(["detect", "--data", at("corpus"), "--limit", "200", "--out", at("check")]) == 0
    assert json.loads(json.dumps(io.read_report(spark, at("check"))))["check"][0]["recall"] > 0.7
    assert main(["pairs", "--sentences", f"{sf}/documents.parquet", "--out", at("data"), "--smoke", "--spec", at("levels")]) == 0
    assert {r["level"] for r in io.read_jsonl(spark, at("data/train")).collect()} == {0, 1, 2, 3}
    io.write_jsonl(utterances(spark, sf).withColumn("level", F.col("asked_level")).limit(300), at("data/real_eval"))
    assert main(["evaluate", "--data", at("data"), "--out", at("out"), "--spec", at("levels"), "--frequencies", at("words"), "--limit", "40", "--qualitative", "2"]) == 0
    assert main(["roundtrip", "--generated", at("out/generated"), "--out", at("out")]) == 0
    got = io.read_report(spark, at("out/report"))
    assert {"rate_control", "rate_error", "fidelity", "type_mix", "placement", "round_trip"} == set(got)
    assert all(r["kept"] == 1 for r in got["fidelity"] if r["system"] == "injector" and r["asked_level"] == 0)
    assert main(["copyfail", "--generated", at("out/generated"), "--vocabulary", at("corpus"), "--out", at("copy")]) == 0
    assert main(["surprisal", at("corpus"), "--frequencies", at("words"), "--out", at("effect"), "--draws", "50"]) == 0
    assert io.read_report(spark, at("effect"))["corpus"][0]["n"] > 0
