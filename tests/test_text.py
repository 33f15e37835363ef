import random

import pytest
from pyspark.sql import functions as F

from disfluo.functions import text as X

CASES = {
    "spoken_text": [("Send the \"Big\" report, to Sarah - now!", "send the big report to sarah now"), ("", ""), ("it's  (well-known)...", "it's well-known"), ("è à é,", "")],
    "words_only": [("l'été_x né!", "l'étéx né"), ("a  b,c", "a bc"), ("", "")],
    "detokenise": [('the " report " , which is n\'t ( here ) .', "the report, which isn't (here)."), ("cost £ 5", "cost £5")],
    "pre_clean": [("We went <laughter> home. ((x)) #y <<noise here>>", "We went home. x y")],
    "normalise": [('"Hello,"', "hello"), ("don't.", "don't")],
    "unigram_key": [("'Hi…'", "hi…")],
}


@pytest.mark.parametrize("name", CASES)
def test_string_functions(spark, name):
    df = spark.createDataFrame([(a,) for a, _ in CASES[name]], "t string").select(getattr(X, name)(F.col("t")).alias("r"))
    assert [r[0] for r in df.collect()] == [b for _, b in CASES[name]]


def test_unicode_white_space_and_ascii_test(spark):
    r = spark.createDataFrame([("a b c è",)], "t string").select(F.size(X.tokens(F.col("t"))), F.size(X.canonical_tokens(F.col("t")))).first()
    assert tuple(r) == (4, 3)


@pytest.mark.parametrize("text, complete", [("a b /", True), ("a b -/", False), ("a -- b /", False), ("[ a + b /", False), ("{F uh, a /", False), ("a b", False), (" {F uh, } [ a + a ] / ", True)])
def test_complete_units(spark, text, complete):
    assert spark.createDataFrame([(text,)], "t string").select(X.is_complete(F.col("t"))).first()[0] is complete


@pytest.mark.parametrize("words, tidy", [([",and", "so", "on,"], ["And", "so", "on."]), ([",", "yes?"], ["Yes?"]), (["word"], ["Word."]), ([",", "-"], []), ([], []), (["a", ",", "b"], ["A", "b."])])
def test_tidy(spark, words, tidy):
    assert spark.createDataFrame([(words,)], "w array<string>").select(X.tidy(F.col("w"))).first()[0] == tidy


def test_content_clause_control(spark):
    df = spark.createDataFrame([("Report,", 2), ("the", 0), ("yes\"", 3), ("and;’", 1)], "w string, k int")
    got = df.select(X.is_content(F.col("w")), X.ends_clause(F.col("w")), X.control_level(X.control_source(F.col("k"), F.col("w")))).collect()
    assert [tuple(r) for r in got] == [(True, True, 2), (False, False, 0), (False, False, 3), (False, True, 1)]
    assert spark.createDataFrame([("plain",)], "t string").select(X.control_level(F.col("t"))).first()[0] is None


@pytest.mark.parametrize("raw, usable", [
    ("The boys went home early .", True), ("the boys went home early .", False), ("The boys ' went home early .", False), ("Too short here .", False), ("It was the very old St.", False),
    ("It was 3 4 5 6 then .", False), ("This has a | bar in it .", False), ("The boys' own team won it all .", False)])
def test_usable_sentences(spark, raw, usable):
    assert spark.createDataFrame([(raw,)], "t string").select(X.is_usable_sentence(F.col("t"))).first()[0] is usable


def test_spoken_form_matches_python(spark):
    from disfluo.functions import lexicon as L

    rng = random.Random(5)
    words = ["".join(rng.choice("abZé'\"“».,-!…( ") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(X.spoken_form(F.col("w"))).collect()]
    table = str.maketrans("", "", L.QUOTES)
    assert got == [w.translate(table).strip(L.STRIP).lower() for w in words]


def test_quick_tests_of_sentences_beside_plain_ones(spark):
    rng = random.Random(8)
    words = ["We", "the", "so,", "(No", "n't", "'s", "'", "boys'", "don't", "n'ts", "3", "4th", "£", "£5", "$ 6", "(", ")", ",", "%", "-", "--", "a-b", "St.", "no.", "home.", "well", "I'LL", "[", "é", "http", "=", "“", '"', "K's"]
    gaps = [" "] * 12 + ["  ", "\t", "\u00a0", "\u2003", "\r", "\x85", "\x1f", ""]
    texts = [None, "", " ", "The.", "A b c d e.", "A" + " b" * 38 + " c.", "A" + " b" * 39 + " c.", "So it is 4 5."]
    for _ in range(20000):
        text = "".join(rng.choice(words[rng.choice([0, 1, 8, 25]) :] if rng.random() < 0.1 else words[:2] + words[8:9] + words[25:26] + words) + rng.choice(gaps) for _ in range(rng.choice([3, 4, 5, 6, 8, 12, 45])))
        texts.append(rng.choice(["", "", "The ", "So ", ' "', "“Like "]) + text.strip(rng.choice(["", " "])) + rng.choice([".", " .", "!", "?", '."', " ? ”", ". ", ".\x85", ""]))
    t, raw = F.col("t"), F.col("raw")
    out = F.array_join(X.tokens(F.translate(t, '"“”', "")), " ")
    for pattern in (X.CLITICS, X.SPACE_BEFORE, X.SPACE_AFTER):
        out = F.regexp_replace(out, pattern, "$1")
    rows = spark.createDataFrame([(x,) for x in texts], "raw string").repartition(8).select("raw", F.explode(F.array("raw")).alias("t")).select("raw", F.explode(F.array(F.trim(out))).alias("t"))
    count = lambda test: F.size(F.filter(X.tokens(t), test))
    n = F.size(X.tokens(t))
    want = t.rlike("^[A-Z]") & t.rlike("[.!?]$") & n.between(5, 40) & t.rlike(X.ALLOWED) & ~t.rlike(X.LOOSE_APOSTROPHE) & (count(lambda w: w.rlike("^[0-9]")) <= F.floor(n / 3)) & (count(lambda w: ~w.rlike("[0-9a-zA-Z]")) == 0)
    for part in X.BAD_PARTS:
        want = want & ~raw.contains(part)
    for part in X.ABBREVIATIONS:
        want = want & ~t.endswith(part)
    rows = rows.withColumn("want", want).withColumn("got", X.is_usable_sentence(raw)).withColumn("steps", X.may_be_usable(raw) & X.is_usable(X.as_sentence(raw))).withColumn("same", X.as_sentence(raw).eqNullSafe(t) & X.detokenise(raw).eqNullSafe(t))
    rows = rows.withColumn("ambiguous", X.is_ambiguous(t).eqNullSafe(X.has_ambiguous(F.split(t, " ")))).persist()
    assert rows.filter("not (want <=> got) or not (want <=> steps) or not same or want and not ambiguous").collect() == []
    assert rows.filter("want").count() > 500 and rows.filter("not want").count() > 5000 and rows.filter("want and raw <> t").count() > 100
    rows.unpersist()
