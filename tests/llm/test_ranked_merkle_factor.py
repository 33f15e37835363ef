"""Operators 11 to 13 against plain versions, on odd tables, and by held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from disfluo.llm import common, factor, langid, merkle, mixing, pagetext, ranked, sampling, toxicity

MID = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = {"pid": 1, "rank": 2, "leaf": "x", "level": 3, "idx": 4, "digest": "d", "n": 5, "total": 6, "term": "t", "terms": 7, "q": 8, "score": 0.5, "key": "k", "kind": 9, "label": 1, "chars": 2, "name": "z", "given": 1, "tampered": 2}


def with_more(df):
    return df.select("*", *[F.lit(v).alias(c) for c, v in CLASHING.items()])


# --- 13: the tree by plain recursion over lists


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + 3])) for k in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, at):
    for nodes in tree[:-1]:
        a = at // 3 * 3
        yield nodes[a:at], nodes[at + 1 : a + 3]
        at //= 3


def plain_proofs(rows):
    """doc_id, leaf, subroot, root, proof, folded root, verified of rows (doc_id, text, lang, source, n_chars)."""
    fields = lambda r: (r[0], r[3], r[2], r[4], r[1])
    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append((r, plain_leaf(fields(r))))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(by_source[s], key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1])) for s in names}
    trees = {s: (own, levels([leaf for _, leaf in own])) for s, own in trees.items()}
    top = levels([trees[s][1][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        own, tree = trees[s]
        for at, (row, leaf) in enumerate(own):
            links = [*siblings(tree, at), *siblings(top, k)]
            text = row[1]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            h = plain_leaf(fields((row[0], text, *row[2:])))
            for before, after in links:
                h = sha("".join(before) + h + "".join(after))
            proof = sha("".join("".join(b) + "".join(a) for b, a in links))
            out.append((row[0], leaf, tree[-1][0], top[-1][0], proof, h, h == top[-1][0]))
    return out


def shown(rows):
    return sorted(map(str, (tuple(r) for r in rows)))


@pytest.mark.parametrize("sizes, piece_rows", [([1], 5), ([3, 1, 0, 9], 2), ([100, 27, 2, 81], 7), ([40, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1], 1000)])
def test_proofs_against_plain_lists(spark, sizes, piece_rows):
    rng, rows = random.Random(sum(sizes)), []
    for k, n in enumerate(sizes):
        for _ in range(n):
            rows.append((rng.choice([None, *range(-50, 400)]), rng.choice([None, "", "a\nb", "one\n", "é\n\nz", "plain"]), rng.choice([None, "en"]), None if k == 1 else f"s{'é' * (k % 2)}{k}", rng.choice([None, 7])))
    rows += rows[:3]
    rng.shuffle(rows)
    docs = with_more(spark.createDataFrame(rows, DOCS)).repartition(3)
    got = merkle.proofs(docs, merkle.Shape(piece_rows=piece_rows, merge_rows=3)).collect()
    assert shown(got) == shown(plain_proofs(rows))


def test_manifest_holds_every_node(spark):
    rows = [(k, f"text {k}", "en", f"s{k % 7 % 3}", k) for k in range(120)]
    got = merkle.manifest(spark.createDataFrame(rows, DOCS), merkle.Shape(piece_rows=11, merge_rows=3)).collect()
    want = set()
    for s in ("s0", "s1", "s2"):
        tree = levels([plain_leaf((r[0], r[3], r[2], r[4], r[1])) for r in rows if r[3] == s])
        want |= {("source", s, level, k, h) for level, nodes in enumerate(tree) if level for k, h in enumerate(nodes)}
    assert want == {tuple(r) for r in got if r["tree"] == "source"} and len([r for r in got if r["tree"] == "source"]) == len(want)
    assert len([r for r in got if r["tree"] == "root"]) == 1
    assert merkle.proofs(spark.createDataFrame([], DOCS)).count() == 0 and merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0


def test_other_fanouts_and_carries():
    for fanout in (2, 3, 5):
        for n in (1, 2, 3, 7, 25, 26, 125):
            r = merkle.Range(fanout)
            leaves = [hashlib.sha256(bytes([k])).digest() for k in range(n)]
            for k, leaf in enumerate(leaves):
                r.push(k and 0, k, leaf)
            r.close(n)
            nodes = leaves
            while len(nodes) > 1:
                nodes = [merkle.parent_of(nodes[k : k + fanout]) for k in range(0, len(nodes), fanout)]
            assert r.stack == [(len(merkle.widths(n, fanout)) - 1, 0, nodes[0])]


# --- 12: scores by dictionaries


def plain_search(docs, items, best):
    term = re.compile(ranked.TERM)
    lowered = lambda t: (t or "").translate(str.maketrans(ranked.UPPER, ranked.LOWER))
    counts = [(i, Counter(term.findall(lowered(t)))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, tokens = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in sorted({(i, tuple(sorted(set(term.findall(lowered(t)))))) for i, t in items}, key=str):
        scored = []
        for i, c, n in counts:
            m = 100 - 50 + 50 * n * n_docs // tokens
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in text if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored)[:best])]
    return sorted(out, key=str)


@pytest.mark.parametrize("cfg", [ranked.Search(), ranked.Search(best=3, block_bytes=400), ranked.Search(best=5, block_bytes=3000, items_bytes=60)])
def test_search_against_plain_scores(spark, cfg):
    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(60)] + ["Ünïq", "ÜNÏQ", "X9", "x9", "日本語", "don't", "a_b"]
    weights = [1 / (k + 1) for k in range(len(vocab))]
    docs = [(rng.choice([None, *range(500)]), " ".join(rng.choices(vocab, weights, k=rng.choice([1, 5, 40, 300]))), "en", "s", None) for _ in range(300)]
    docs += docs[:4] + [(7, None, "en", "s", 1), (8, "", None, None, 1), (9, " .,;\n", None, None, 1), (10, "x9 " * 50_000, None, None, 1)]
    items = [(k, " ".join(rng.choices(vocab, k=12))) for k in range(12)] + [(3, "w1 w2 X9"), (3, "X9 w2 w1 w1"), (None, "日本語 w0"), (90, None), (91, "..."), (92, "nowhere")]
    got = ranked.search(with_more(spark.createDataFrame(docs, DOCS)).repartition(5), spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(1)), cfg).collect()
    assert sorted(map(tuple, got), key=str) == plain_search([d[:2] for d in docs], items, cfg.best)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b", "en", "s", 3)], DOCS), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked.search(docs.filter("false"), items).count() == 0 and ranked.search(docs, items.filter("false")).count() == 0
    assert [tuple(r)[:3] for r in ranked.search(docs, items).collect()] == [(1, 1, 1)]


def test_scores_stop_early_only_when_proven():
    """Common postings of low impact are left unread, and nothing is lost."""
    rng = np.random.default_rng(4)
    for _ in range(40):
        n, terms = 600, 5
        df = [6, 9, 300, 400, 500]
        rows = [(t, d, rng.integers(1, 4)) for t in range(terms) for d in rng.choice(n, df[t], replace=False)]
        term, doc, tf = (np.array(x) for x in zip(*rows))
        arrays = {"ids": np.arange(n), "nulls": np.zeros(n, bool), "lens": rng.integers(20, 60, n), "term": term.astype(np.int32), "doc": doc.astype(np.int32), "tf": tf.astype(np.int32)}
        groups = ranked.Groups({k: common.squeezed(v.tobytes()) for k, v in arrays.items()} | {"n_postings": len(term), "n_docs": n}, n, int(arrays["lens"].sum()))
        weights = np.array([9000, 8000, 40, 30, 20])
        whole = np.zeros(n, np.int64)
        m = 50 + 50 * arrays["lens"] * n // arrays["lens"].sum()
        np.add.at(whole, doc, weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc])))
        at, scores, added = ranked.score_at_a_time(groups, np.arange(terms), weights, 3, np.zeros(0, np.int64))
        want = np.lexsort((np.arange(n), -whole))[:3]
        assert set(want) <= set(at.tolist()) and (scores == whole[at]).all() and added < len(term) / 2
        top = np.sort(whole)[::-1][:3]
        again, scores, _ = ranked.score_at_a_time(groups, np.arange(terms), weights, 3, top + 1)
        assert not len(again) or (whole[again] == scores).all()


# --- 11


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    lens = [1, 4, 9]
    v, x = rng.normal(size=(sum(lens), 3)), rng.normal(size=sum(lens))
    got, _ = factor.interactions(v, x, np.array([0, 1, 5]))
    a = 0
    for k, n in enumerate(lens):
        assert got[k] == pytest.approx(sum(v[i] @ v[j] * x[i] * x[j] for i in range(a, a + n) for j in range(a, i)))
        a += n


def test_gradients_find_an_interaction():
    """Two words that mark label 1 only alone or only together can't be told by linear weights."""
    rng, rows, labels = np.random.default_rng(2), [], []
    for _ in range(400):
        a, b = rng.integers(0, 2, 2)
        rows.append((np.array([0, *([1] if a else []), *([2] if b else [])]), np.ones(1 + a + b), np.zeros(2)))
        labels.append(float(a != b))
    model = factor.fit_machine(rows, np.array(labels), np.ones(400), factor.Machine(buckets=4, factors=3, epochs=600))
    assert ((model.scores(rows) >= 0.5) == (np.array(labels) == 1)).mean() == 1


def test_held_out_quality(spark):
    got = {r["doc_id"]: r for r in factor.op11_quality_classifier(spark, MID).collect()}
    labels = [(r["doc_id"], r["quality"]) for r in common.read(spark, MID, "labels").collect() if r["quality"] is not None]
    held = [(got[i]["predicted"], y) for i, y in labels if got[i]["held_out"]]
    assert len(got) == 1000 and len(held) > 80 and sum(p == y for p, y in held) / len(held) > 0.95
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and got[i]["predicted"] == int(got[i]["score"] >= 0.5) for i in got)


def test_quality_of_odd_rows(spark):
    rows = [(1, "good words here", "en", "a", 3), (2, None, None, None, None), (3, "", "en", "a", -4), (4, "### %%% ### $$$", "en", "a", 10), (4, "### %%% ### $$$", "en", "a", 10), (None, "no id", "en", "a", 1), (6, "word " * 300_000, "en", "a", None)]
    docs, labels = with_more(spark.createDataFrame(rows, DOCS)), spark.createDataFrame([(1, 1), (4, 0), (6, 1), (6, None), (None, 0), (2, 0)], "doc_id long, quality int")
    model = factor.train(docs, labels)
    assert model.weights is not None
    got = factor.score(docs, model).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in factor.score(docs, factor.train(docs, labels.filter("quality = 1"))).collect()} == {1.0}
    assert {r["score"] for r in factor.score(docs, factor.train(docs, labels.filter("false"))).collect()} == {0.5}
    assert factor.score(docs.filter("false"), model).count() == 0 and factor.score(docs.drop("n_chars"), model).count() == len(rows)


def test_samples_are_bounded_and_whole(spark):
    """Rows of one id, or without id, are drawn one by one, copies once, and never more than the bound."""
    rows = spark.range(40_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 7001).cast("string")).alias("text"), F.when(F.col("id") % 7001 < 6000, "a").otherwise("b").alias("kind"))
    keys = rows.select("kind", sampling.key_of(F.col("doc_id"), F.col("text"), "s").alias("key"), F.length("text").alias("chars"))
    drawn, counts = sampling.chosen(keys, 500, 10**9)
    assert counts == {"a": 6000, "b": 1001} and Counter(r["kind"] for r in drawn.collect()) == {"a": 500, "b": 500}
    few, _ = sampling.chosen(keys, 500, 100)
    assert all(1 <= n <= 16 for n in Counter(r["kind"] for r in few.collect()).values())


# --- samples of operators 4 and 9, the order of 3, copies in 6


def test_languages_are_learned_whatever_the_ids_are(spark):
    docs = common.read(spark, MID, "documents").filter("text is not null and lang is not null")
    many = docs.crossJoin(spark.range(3).select(F.col("id").alias("copy"))).withColumn("text", F.concat("text", F.lit(" "), F.col("copy").cast("string"))).drop("copy")
    cfg = langid.Fit(bound=60)
    for ids in (F.lit(None).cast("long"), F.lit(9).cast("long"), F.col("doc_id")):
        model = langid.fit(many.withColumn("doc_id", ids), cfg)
        assert model.langs == sorted({r["lang"] for r in docs.select("lang").distinct().collect()})
        got = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("lang_pred <> 'und'")
        assert got.filter("lang_pred = lang").count() > 0.97 * got.count()


def test_toxic_rows_of_few_ids_are_learned_in_bounds(spark, monkeypatch):
    """Ids with thousands of different texts, and one text repeated as often, give bounded samples of both classes."""
    docs = spark.range(6000).select((F.col("id") % 3).alias("doc_id"), F.concat(F.when(F.col("id") % 3 == 0, "vile filth ").otherwise("kind words "), F.when(F.col("id") % 3 == 1, F.lit("")).otherwise(F.col("id").cast("string"))).alias("text"))
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    seen = []
    real = toxicity.fit_noisy_or
    monkeypatch.setattr(toxicity, "fit_noisy_or", lambda bags, y, importance, cfg: (seen.append(Counter(y.tolist())), real(bags, y, importance, cfg))[1])
    model = toxicity.train(docs, labels, toxicity.Training(bound=200, bound_chars=10**6))
    assert seen == [Counter({0: 200, 1: 200})] and model.score("vile filth 7") > 0.7 > model.score("kind words 7")


def test_documents_without_id_are_put_in_slices(spark):
    rows = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"), F.lit("a").alias("source"))
    assert mixing.sizes(rows).select("order").distinct().count() == 4000
    assert sum(r["taken"] for r in mixing.mix(rows, slice_rows=100).collect()) == 8000


def test_views_of_one_story_keep_it(spark):
    """A page between other views of its story keeps the story, marked or not, and loses what pages of other stories share."""
    rng = random.Random(3)
    story = [" ".join(rng.choices([f"w{k}" for k in range(400)], k=20)) for _ in range(6)]
    for tag in ("article", "div"):
        for views in (("amp", "mobile", "print"), ("amp", "print"), tuple(f"v{k}" for k in range(10))):
            page = lambda v: f"<p>menu home about</p><{tag}>" + "".join(f"<p>{p}</p>" for p in story) + f"<p>{v} version</p></{tag}>"
            pages = [(k, f"http://h.net/story/{v}", page(v)) for k, v in enumerate(views)]
            got = {r["page_id"]: r["text"].split("\n") for r in pagetext.extract(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)).collect()}
            assert all(set(story) < set(got[k]) and f"{v} version" in got[k] for k, v in enumerate(views)), (tag, views)
    other = [(k, f"http://h.net/{k}", "<p>menu home about us and our many friends all over</p><p>Own text of page " + " ".join(rng.choices(story[k].split(), k=15)) + "</p>") for k in range(4)]
    got = pagetext.extract(spark.createDataFrame(other, "page_id long, url string, html string").coalesce(1)).collect()
    assert all(r["text"].startswith("Own text") for r in got)


def test_each_proof_is_folded_not_assumed(spark, monkeypatch):
    """Where siblings are spoiled, leaves that nobody tampered with don't fold to the root either."""
    docs = spark.createDataFrame([(k, "a", "en", 1, f"t{k}") for k in range(40)], "doc_id long, source string, lang string, n_chars int, text string")
    shape = merkle.Shape(piece_rows=7)
    assert all(r["verified"] and r["folded_root"] == r["root"] for r in merkle.proofs(docs, shape).collect())
    borrowed = merkle._borrowed
    monkeypatch.setattr(merkle, "_borrowed", lambda trees: borrowed(trees).withColumn("digest", F.unhex(F.lit("00" * 32))))
    wrong = merkle.proofs(docs, shape).collect()
    assert len(wrong) == 40 and any(not r["verified"] and r["folded_root"] != r["root"] for r in wrong)
