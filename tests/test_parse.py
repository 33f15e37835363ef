import pytest

from disfluo.operators import parse


def run(spark, texts):
    df = parse.utterances(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), least=1)
    return [r.asDict(recursive=True) for r in df.orderBy("i").collect()]


CASES = [
    ("[ the cat, + the dog ] barked. /", "The dog barked.", ["repair"]),
    ("[ six, + six ] geese flew over /", "Six geese flew over.", ["repetition"]),
    ("[ the left, + {E or rather, } the right ] shoe is wet /", "The right shoe is wet.", ["repair"]),
    ("they [ want to, + ] shut the gate /", "They shut the gate.", ["false_start"]),
    ("{F Um, } rain is coming. /", "Rain is coming.", ["filler"]),
    ("{D well, } {F uh, } it broke /", "It broke.", ["filler"]),  # one run of dropped words is one filler
    ("{F oh, } she {F um, } left /", "She left.", ["filler", "filler"]),
    ("{C So } he sang {A quite } loudly. /", "So he sang quite loudly.", []),  # these groups stay
    ("Turn <noise> it off. /", "Turn it off.", []),
    ("Both ((lamps)) # are lit. /", "Both lamps are lit.", []),
    ("[ [ a, + a ] red, + a blue ] kite /", "A blue kite.", ["repetition", "repair"]),  # a repair within a repair's first attempt
    ("[ he, + [ she, + they ] ] came /", "They came.", ["repair", "repair"]),  # and within its correction
    ("[ go {F uh, } now, + leave {F um, } now ] please /", "Leave now please.", None),
]


@pytest.mark.parametrize("text, clean, types", CASES)
def test_markup(spark, text, clean, types):
    r = run(spark, [text])[0]
    assert r["status"] == "kept" and " ".join(r["clean_tokens"]) == clean
    if types is not None:
        assert [a["type"] for a in r["annotations"]] == types
    assert len(r["alignment"]) == len(r["disfluent_tokens"])
    assert [x for x in r["alignment"] if x is not None] == list(range(len(r["clean_tokens"])))


def test_editing_term_is_the_interregnum(spark):
    r = run(spark, [CASES[2][0]])[0]
    a = r["annotations"][0]
    assert r["disfluent_tokens"][a["interregnum"]["start"] : a["interregnum"]["end"]] == ["or", "rather"]
    assert r["disfluent_tokens"][a["reparandum"]["start"] : a["reparandum"]["end"]] == ["the", "left"]


@pytest.mark.parametrize("text", ["no slash here", "cut off -/", "cut -- off /", "[ one + two /", "one } two /", "one ] [ two /", "} { /", "{F um } /", "/", None])
def test_rejected(spark, text):
    assert run(spark, [text])[0]["status"] == "unparsed"


def test_lengths_and_first_occurrences(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (0, "a"), (3, "a")], "ord int, k string")
    assert sorted(map(tuple, parse.first_occurrence(df, "k", "ord").collect())) == [("a", 0, 3), ("b", 2, 1)]
    out = parse.utterances(spark.createDataFrame([("one two /",), ("one two three four five /",)], "text string")).collect()
    assert [r.status for r in out] == ["length", "kept"]
