"""The pipeline's stages, each on its own input, and its run as a whole."""

import datetime
from decimal import Decimal

import duckdb
import pytest

import corpus_pipeline
from disfluo.llm import common, toxicity
from disfluo.llm.mixing import ORACLE_OP3
from tests.llm.test_methods import classes_by_all_pairs, removed_by_brute_force


def test_stages(spark, tmp_path, sf):
    docs = common.read(spark, sf, "documents")
    columns, given = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(f"file://{tmp_path}/{name}")
        given[name] = (docs, spark.read.parquet(f"file://{tmp_path}/{name}"))
        docs = given[name][1]
        assert docs.columns[: len(columns)] == columns
    before, after = given["toxicity"]
    model = toxicity.train(before, common.read(spark, sf, "labels"))
    keep = [r["doc_id"] for r in before.collect() if model.score(r["text"]) < 0.7]
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(keep)
    before, after = (x.toPandas() for x in given["near_duplicates"])
    root = classes_by_all_pairs(before[["doc_id", "text"]].to_numpy().tolist())
    assert sorted(after["doc_id"]) == sorted(set(root.values()))
    before, after = (x.toPandas() for x in given["repeated_strings"])
    want = removed_by_brute_force(before[["doc_id", "text"]].to_numpy().tolist())
    texts = dict(zip(after["doc_id"], after["text"]))
    for i, t in zip(before["doc_id"], before["text"]):
        size, gone, _, _ = want[i]
        assert texts[i] == t if not gone else abs(len(texts.get(i, "").encode()) - (size - gone)) <= 6
    before, after = (x.toPandas() for x in given["decontamination"])
    items = [x.lower() for x in common.read(spark, sf, "benchmark").toPandas()["text"]]
    leaked = {i for i, t in zip(before["doc_id"], before["text"]) if any(x in t.lower() for x in items)}
    assert leaked.isdisjoint(after["doc_id"]) and len(before) - len(after) <= len(leaked) + 5
    before, after = given["mixing"]
    con = duckdb.connect()
    con.register("documents", before.select("doc_id", "text", "source").toPandas())
    want = {r[0]: r[4] // r[1] for r in con.sql(ORACLE_OP3).fetchall() if r[4]}
    assert {r["doc_id"]: r["copies"] for r in after.collect()} == want


def test_run_and_odd_rows(spark, tmp_path, sf):
    rows = [(1, "one two three four five six seven eight nine ten eleven", "en", "a", 5), (2, None, None, None, None), (3, "", "en", "a", 0), (4, "one two three four five six seven eight nine ten eleven", "en", "b", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        common.read(spark, sf, t).limit(3).write.parquet(f"{tmp_path}/{t}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} <= {1, 2, 3} and 1 in {r["doc_id"] for r in out}


TEXTS = ["one two three four five six seven eight nine ten eleven", None, "", " \n ", "it stands alone, and nothing else is like it at all", "long " * 70_000 + "tail", "tie tie tie"]
ODD = [(1, 0, "a"), (4, 0, "b"), (1, 4, "a"), (None, 0, "a"), (None, 4, None), (2, 1, None), (3, 2, "a"), (7, 3, "b"), (5, 5, "a"), (6, 5, "b"), (8, 6, "c"), (8, 6, "c")]
CLASHING = "_id int, row int, copies string, judged int, leak int, block int, bucket int, id int, null_text boolean, x0 array<int>, x1 struct<`a b`: int, b: array<string>>, `dotted.name` int, x2 map<string, int>, x3 timestamp, x4 decimal(20, 3), x5 binary"
OTHER = (1, 2, "three", 4, 5, 6, 7, 8, True, [1, None], (1, ["p", None]), 9, {"k": 1}, datetime.datetime(2020, 1, 2, 3, 4, 5), Decimal("1.500"), bytearray(b"\x00\xff"))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_odd_rows_and_clashing_columns(spark, sf, name, stage):
    """Every stage on nulls, empty and very long texts, repeated rows, shared ids, and columns of any name and type."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING
    rows = [(i, TEXTS[t], "en", s, None if TEXTS[t] is None else len(TEXTS[t]), *OTHER) for i, t, s in ODD]
    docs = spark.createDataFrame(rows, schema)
    out = stage(spark, docs, sf)
    extra = ["copies_"] if name == "mixing" else []
    assert out.columns == docs.columns + extra and [out.schema[c].dataType for c in docs.columns] == [f.dataType for f in docs.schema]
    got = out.collect()
    assert all(tuple(r[c] for c in docs.columns[5:]) == tuple(docs.first()[5:]) for r in got)
    seen = sorted(((r["doc_id"], TEXTS.index(r["text"])) for r in got), key=str) if name != "repeated_strings" else None
    every = sorted(((i, t) for i, t, _ in ODD), key=str)
    if name in ("toxicity", "decontamination"):
        assert seen == every
    elif name == "near_duplicates":  # one row of each text with words, the least by id; all without words
        assert seen == sorted([(1, 0), (1, 4), (2, 1), (3, 2), (7, 3), (5, 5), (8, 6)] + [], key=str)
    elif name == "mixing":
        assert all(1 <= r["copies_"] <= 3 for r in got) and {t for _, t in seen}.isdisjoint({1, 2, 3})
    else:  # copies of a text with another id lose all they share with a smaller one; a row left without words goes
        left = sorted(((r["doc_id"], r["text"] if r["text"] is None else r["text"][:9], r["n_chars"]) for r in got), key=str)
        assert (4, "one two t", 55) not in left and (1, "one two t", 55) in left and (2, None, None) in left and (3, "", 0) in left and (5, TEXTS[5][:9], len(TEXTS[5])) in left and not any(i == 6 for i, _, _ in left)
    none = stage(spark, docs.filter("false"), sf)
    assert none.columns == out.columns and none.count() == 0
