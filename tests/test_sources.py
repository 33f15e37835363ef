import json

from pyspark.sql import functions as F

from disfluo.functions.report import markdown
from disfluo.operators import corpus, pools, systems
from disfluo.plans.evaluation import RULES
from disfluo.sources import io
from disfluo.streaming import speak


def test_transcripts_are_parsed_and_first_copies_kept(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/1.csv").write_text('text,conversation_no\n"{F Uh, } we went home again today. /",1\n"too short /",1\n"broken -/",1\n')
    (tmp_path / "a/2.csv").write_text('text,conversation_no\n"{F Uh, } we went home again today. /",2\n')
    rows = io.load_utterances(spark, str(tmp_path))
    assert {r["status"]: r["n"] for r in io.parse_counts(rows).collect()} == {"kept": 1, "duplicate": 1, "length": 1, "unparsed": 1}
    assert rows.filter("status = 'kept'").first()["conversation_no"] == "1"


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    """Layouts in one folder, a cell over several lines and across a split, blank lines, bytes that are no text, a file of another kind."""
    (tmp_path / "a.csv").write_text('text,conversation_no\n"one, ""quoted""\nand on",1\n\nplain,2\n')
    (tmp_path / "b.csv").write_text("conversation_no,act,text\n3,x,three\n")
    (tmp_path / "c.csv").write_text("other,thing\nno,4\n")
    (tmp_path / "d.csv").write_bytes(b"text\ncaf\xff bar\n")
    (tmp_path / "e.csv").write_text("")
    (tmp_path / "f.csv").write_text('id,text\n1,"' + "\n".join(f"line {k}" for k in range(2000)) + '"\n2,last\n')
    rows = [r[:2] for r in io.read_transcripts(spark, str(tmp_path)).orderBy("file", "ord").collect()]
    want = [('one, "quoted"\nand on', "1"), ("plain", "2"), ("three", "3"), ("caf\ufffd bar", None), ("\n".join(f"line {k}" for k in range(2000)), None), ("last", None)]
    assert rows == want
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert [r[:2] for r in io.read_transcripts(spark, str(tmp_path)).orderBy("file", "ord").collect()] == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_system_is_replaced_and_others_stay(spark, tmp_path):
    rows = lambda system, level, n: spark.range(n).select(F.col("id").alias("utt_id"), F.lit(system).alias("system"), F.lit(level).alias("level"))
    for system, level, n in (("a", 1, 3), ("b", 1, 4), ("b", 2, 5), ("b", 1, 2)):
        io.write_generations(rows(system, level, n), str(tmp_path / "g"))
    assert sorted((r["system"], r["level"], r["count"]) for r in io.read_generations(spark, str(tmp_path / "g")).groupBy("system", "level").count().collect()) == [("a", 1, 3), ("b", 1, 2), ("b", 2, 5)]


def test_early_stop_keeps_the_same_sentences(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").filter("text is not null").select("doc_id", "text").repartition(6)
    rows = rows.unionByName(rows)
    for limit in (1, 10, 60):
        whole, early = (io.with_quota(io.usable_sentences(rows, "doc_id", most), limit).collect() for most in (None, limit))
        assert whole == early
    assert io.usable_sentences(rows, "doc_id", 5).count() <= 2 * 5 * 12


def test_first_sentences_in_any_order_of_rows(spark):
    """Small batches, falling and mixed ids, ids beyond a double's digits beside none, copies that stand earlier in a later batch."""
    text = lambda k: f"Row {'abcdefgh'[k % 8]}{'xyz'[k % 3]} is {'well' if k % 5 == 0 else 'good'} and it ends.\n= Not this one at all.\nThen come the words {'pqr'[k % 3]}. So it goes on here."
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for ids in (range(300, 0, -1), [(k * 37) % 301 for k in range(300)], [None if k == 3 else 2**53 + (k * 37) % 301 for k in range(300)]):
            rows = spark.createDataFrame([(i, text(k)) for k, i in enumerate(ids)], "doc_id long, text string").repartition(3)
            for limit in (1, 4, 20):
                whole, early = (io.with_quota(io.usable_sentences(rows, "doc_id", most), limit).collect() for most in (None, limit))
                assert whole == early and whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_table_without_wanted_sentences_is_passed_over(spark, tmp_path):
    path = lambda name: str(tmp_path / name)
    for name, text in (("none", "too short."), ("ambiguous", "So it goes on here."), ("plain", "And it goes on here.")):
        spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(path(name))
    texts = lambda names, limit: [r["text"] for r in io.sentence_source(spark, [path(x) for x in names], limit).collect()]
    assert texts(["missing", "none", "ambiguous", "plain"], 1) == ["And it goes on here."]  # one alone is to be a plain one
    assert texts(["missing", "none", "ambiguous", "plain"], 10) == ["So it goes on here."]
    assert texts(["plain", "ambiguous"], 10) == ["And it goes on here."] and texts(["plain", "none"], 0) == texts(["none"], 5) == texts(["missing"], 5) == texts([], 5) == []


def test_jsonl_round_trip_counts_and_missing_files(spark, tmp_path, sf):
    said = corpus.spoken(corpus.scripts(spark, sf)).limit(50).withColumn("disfluent", F.array_join("disfluent_tokens", " "))
    path = str(tmp_path / "u")
    assert io.write_jsonl(said, path) == 50
    back = io.read_jsonl(spark, path)
    assert {tuple(r["disfluent_tokens"]) for r in back.collect()} == {tuple(r["disfluent_tokens"]) for r in said.collect()}
    assert io.load_pairs(spark, path, limit=7).count() == 7 and io.load_pairs(spark, path).columns == ["clean", "disfluent", "level"]
    assert io.load_pairs(spark, str(tmp_path / "none")).count() == 0 and io.real_pairs(spark, str(tmp_path / "none"), 1, 2).count() == 0
    assert {r["level"] for r in io.real_pairs(spark, path, 10.0, 20.0).collect()} <= {0, 1, 2, 3}


def test_specification_frequencies_and_dumps(spark, tmp_path):
    (tmp_path / "levels.json").write_text('{"a": Infinity, "b": [0, null]}')
    assert io.read_levels(spark, str(tmp_path / "levels.json"))["a"] == float("inf")
    words = spark.createDataFrame([("the", 5, -1.0)], "word string, n long, log_freq double")
    io.write_frequencies(words, str(tmp_path / "f"))
    assert io.read_frequencies(spark, str(tmp_path / "f")).first()["log_freq"] == -1.0 and io.read_frequencies(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "my_d_x_d2.jsonl").write_text(json.dumps({"clean": "a b", "disfluent": "a uh b"}) + "\n\n")
    r = io.read_generation_dumps(spark, str(tmp_path / "*.jsonl")).first()
    assert (r["system"], r["level"]) == ("my_d_x", 2)


def test_generations_and_report(spark, tmp_path):
    scripts = io.read_lines(spark, ["Send the report to Sarah before Friday.", "  ", "Call the office now."]).withColumn("asked_level", F.lit(2))
    said = systems.resolve("rules", RULES).speak(scripts)
    io.write_generations(said.withColumn("system", F.lit("rules")).withColumn("level", F.col("asked_level")), str(tmp_path / "g"))
    assert io.read_generations(spark, str(tmp_path / "g")).filter("system = 'rules' and level = 2").count() == 2
    assert markdown(said.select("utt_id", "spoken"), ["utt_id"]).count("\n") == 3
    assert systems.ByAnnotations().clean(said).filter("recovered <> clean").count() == 0


def test_pools(spark):
    t = pools.template_sentences(spark, ["Meet {name} and {name2} on {day}.", "Call {name}, yes {name}."], {"name": ["Ann", "Bob", "Cy"], "day": ["Monday", "Friday"]}, each=20)
    rows = t.collect()
    assert len({(r.template_id, r.text) for r in rows}) == len(rows) and all("{" not in r.text for r in rows)
    for r in rows:
        w = r.text.replace(".", "").replace(",", "").split()
        assert (w[1] != w[3]) if r.template_id == 0 else (w[1] == w[3])
    sents = spark.createDataFrame([(f"Sentence number {i} here.",) for i in range(100)], "text string")
    p = pools.build_pools(sents, t)
    got = {(r["source"], r["split"]): r["n"] for r in p.groupBy("source", "split").agg(F.count("*").alias("n")).collect()}
    assert got["corpus", "train"] == 80 and got["corpus", "val"] == 4 and got["corpus", "test"] == 16


def test_streams(spark, tmp_path, sf):
    scripts = corpus.scripts(spark, sf).limit(200)
    scripts.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(scripts.schema).parquet(str(tmp_path / "in"))
    q = speak.event_counts(speak.spoken_stream(stream)).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = speak.event_counts(speak.spoken_stream(spark.read.parquet(str(tmp_path / "in"))))
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, batch.collect()))
    pairs = spark.createDataFrame([(1, "Send the report.", "send the uh report")], "utt_id long, clean string, spoken string")
    pairs.write.parquet(str(tmp_path / "pairs"))
    q = speak.detected_stream(spark.readStream.schema(pairs.schema).parquet(str(tmp_path / "pairs"))).writeStream.format("memory").queryName("found").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("found").first()["type"] == "filler"
