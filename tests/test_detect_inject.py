import random
from difflib import SequenceMatcher

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from disfluo.operators import detect as D
from disfluo.operators import align, evaluate, inject
from disfluo.plans.evaluation import RULES
from disfluo.plans.inject_sql import rules_sql

SCRIPT = "please carry both green boxes upstairs after lunch".split()


def said_with(at: int, words: str, *more: tuple[int, str]) -> list[str]:
    """The script with words put in before the places given."""
    out = list(SCRIPT)
    for place, extra in sorted([(at, words), *more], reverse=True):
        out[place:place] = extra.split()
    return out


@pytest.mark.parametrize("said, types, dropped", [
    (said_with(3, "um"), ["filler"], []),
    (said_with(5, "i mean"), ["filler"], []),
    (said_with(2, "oh like"), ["filler", "filler"], []),
    (said_with(6, "after"), ["repetition"], []),
    (said_with(1, "carry both"), ["repetition"], []),
    (said_with(5, "downstairs or rather"), ["repair"], []),
    (said_with(3, "grey"), ["repair"], []),
    (said_with(0, "let me"), ["false_start"], []),
    (said_with(4, "well bags sorry"), ["filler", "repair"], []),
    (said_with(2, "um", (6, "after")), ["filler", "repetition"], []),
    ([w for w in SCRIPT if w != "green"], [], ["green"]),
    (["old" if w == "green" else w for w in SCRIPT], ["repair"], ["green"]),
])
def test_types(said, types, dropped):
    r = D.detect(SCRIPT, said)
    assert [a["type"] for a in r["annotations"]] == types and r["dropped"] == dropped


def test_alignment_is_the_longest_block_first_one():
    rng = random.Random(1)
    for _ in range(200):
        clean = [rng.choice("abcdef") for _ in range(rng.randint(1, 12))]
        out = [w for c in clean for w in ([rng.choice("abuh")] if rng.random() < 0.3 else []) + ([c] if rng.random() < 0.9 else [])]
        pairs = {(b.a + k, b.b + k) for b in SequenceMatcher(None, clean, out, autojunk=False).get_matching_blocks() for k in range(b.size)}
        assert {(i, j) for j, i in enumerate(D.detect(clean, out)["alignment"]) if i is not None} == pairs


SENTENCES = ["Mail the monthly invoice to Omar before Tuesday, and then phone the studio.", "Her blue folder holds forty letters; please sort the second half tonight.", "They drove south past the harbour until a narrow lane came into sight."]


@pytest.fixture(scope="module")
def injected(spark):
    """Words and speech of so many renderings of the sentences, as dictionaries."""

    def run(n, rates=RULES[3], sentences=SENTENCES, seed=13):
        rows = spark.createDataFrame([(i, sentences[i % len(sentences)], 1) for i in range(n)], "utt_id long, clean string, asked_level int")
        got = inject.spoken_by_rules(rows, {1: rates}, seed).orderBy("utt_id").collect()
        return [([w.strip(inject.L.STRIP).lower() for w in r["clean"].split()], r.asDict(recursive=True)) for r in got]

    return run


def test_injection_inverts_and_never_overlaps(injected):
    for said, r in injected(300):
        assert sorted(a for a in r["alignment"] if a is not None) == list(range(len(said)))
        assert all(r["disfluent_tokens"][j] == said[a] for j, a in enumerate(r["alignment"]) if a is not None)
        gone = [i for a in r["annotations"] for k in ("reparandum", "interregnum") if a[k] for i in range(a[k]["start"], a[k]["end"])]
        assert len(gone) == len(set(gone)) and set(gone) == {j for j, a in enumerate(r["alignment"]) if a is None}
        assert [D.first_place(a) for a in r["annotations"]] == sorted(D.first_place(a) for a in r["annotations"])


def test_same_seed_same_speech_and_level_zero_is_clean(injected):
    assert injected(5) == injected(5) and injected(50, seed=13) != injected(50, seed=14)
    ((said, r),) = injected(1, inject.Rates())
    assert r["disfluent_tokens"] == said and r["annotations"] == []


def test_expected_counts(injected):
    """The whole part of the rate's events, and one more as often as the rest says; a rate below zero is none."""
    n = [len(r["annotations"]) for _, r in injected(4000, inject.Rates(repetition=10.0), SENTENCES[:1])]
    assert set(n) == {1, 2} and abs(np.mean(n) - 1.3) < 0.03
    assert not any(r["annotations"] for _, r in injected(20, inject.Rates(filler=-4.0)))


def test_shares_of_each_shape(injected):
    """Over many renderings the shares that are published hold: editing phrases, two-word repetitions, spans, late corrections, filler words."""
    notes = [(a, r) for _, r in injected(6000, inject.Rates(repair=8.0, repetition=8.0, filler=8.0)) for a in r["annotations"]]
    size = lambda s: s["end"] - s["start"] if s else 0
    repairs = [a for a, _ in notes if a["type"] == "repair"]
    late = [a for a in repairs if a["interregnum"] and a["interregnum"]["start"] > a["reparandum"]["end"]]
    assert 0.15 < np.mean([a["interregnum"] is not None for a in repairs]) < 0.30 and late and len(late) < 0.15 * len(repairs)
    assert {a["interregnum"]["start"] - a["reparandum"]["end"] for a in late} == {2, 3, 4, 5, 6}
    assert 0.10 < np.mean([size(a["reparandum"]) == 2 for a, _ in notes if a["type"] == "repetition"]) < 0.22
    assert {size(a["reparandum"]) for a in repairs} == {1, 2, 3}
    words = [" ".join(r["disfluent_tokens"][a["interregnum"]["start"] : a["interregnum"]["end"]]) for a, r in notes if a["type"] == "filler"]
    for phrase, weight in inject.L.FILLERS[:3]:
        assert abs(np.mean([w == phrase for w in words]) - weight) < 0.02


def test_restarts_break_off_where_they_may(injected):
    at = []
    for said, r in injected(2000, inject.Rates(false_start=100 / 13), SENTENCES[:1]):
        (a,) = r["annotations"]
        words = r["disfluent_tokens"][a["reparandum"]["start"] : a["reparandum"]["end"]]
        assert " ".join(words) in inject.L.FRAGMENTS and a["repair"]["end"] - a["repair"]["start"] == 3
        at.append(a["reparandum"]["start"])
    assert set(at) == {0, 8} and 0.36 < np.mean([x > 0 for x in at]) < 0.44  # after the comma, or at the start


def test_wrong_words_are_of_the_same_kind(injected):
    """Where one word is said wrong, it comes from its own group, or is a number near it."""
    seen = set()
    for said, r in injected(600, inject.Rates(repair=9.0), ["Send 7 copies to Sarah on Monday."]):
        for a in r["annotations"]:
            wrong = r["disfluent_tokens"][a["reparandum"]["start"] : a["reparandum"]["end"]]
            right = r["disfluent_tokens"][a["repair"]["start"] : a["repair"]["end"]]
            if len(wrong) == len(right) == 1:
                seen.add((right[0], wrong[0]))
    assert {w for r, w in seen if r == "7"} <= {"4", "5", "6", "8", "9", "10", "17"} and len({w for r, w in seen if r == "sarah"}) > 10
    assert all(w in inject.L.SWAPS[r] and w != r for r, w in seen if r != "7")


def test_detector_finds_what_is_injected(injected):
    found = want = drops = 0
    for said, r in injected(400, inject.Rates(filler=12.0)):
        d = D.detect(said, r["disfluent_tokens"])
        found, want, drops = found + len(d["annotations"]), want + len(r["annotations"]), drops + len(d["dropped"])
    assert 0.95 <= found / want <= 1.05 and drops == 0


def test_rules_against_sql_on_sentences_with_swaps(spark):
    """The walk in SQL over sentences whose words have alternatives, at every level and beyond."""
    dial = RULES | {4: inject.Rates(20.0, 20.0, 30.0, 12.0)}
    rows = [(i, i % 5, SENTENCES[i % 3] if i % 4 else "Call Anna, Peter or Tom: the red report, 12 letters; 3 memos!") for i in range(1500)]
    got = inject.spoken_by_rules(spark.createDataFrame(rows, "utt_id long, asked_level int, clean string"), dial).collect()
    con = duckdb.connect()
    con.sql("CREATE TABLE texts (utt_id BIGINT, asked_level INTEGER, clean VARCHAR)")
    con.executemany("INSERT INTO texts VALUES (?, ?, ?)", rows)
    want = con.sql(f"WITH RECURSIVE sents AS (SELECT *, string_split(clean, ' ') AS clean_tokens FROM texts), {rules_sql(dial, 'sents')} SELECT utt_id, disfluent_tokens, alignment, n_events, n_repair FROM ruled JOIN (SELECT utt_id, n_events, n_repair FROM rms) USING (utt_id)").fetchall()
    count = lambda r: sum(a["type"] == "repair" for a in r["annotations"])
    assert sorted((r["utt_id"], r["disfluent_tokens"], r["alignment"], len(r["annotations"]), count(r)) for r in got) == sorted((i, list(d), list(a), n, k) for i, d, a, n, k in want)


def test_odd_scripts(spark):
    rows = [(1, None, 3), (2, "", 3), (3, "...", 3), (4, "One.", 3), (None, SENTENCES[0], 3), (5, SENTENCES[0], None), (6, " ".join(SENTENCES * 40), 3), (7, "red", 3)]
    odd = spark.createDataFrame(rows, "utt_id long, clean string, asked_level int").withColumns({c: F.lit("x") for c in ("said", "events", "told", "here", "others")})
    got = inject.spoken_by_rules(odd, RULES).collect()
    assert len(got) == len(rows) and all(r["said"] == r["told"] == "x" for r in got)
    by = {r["utt_id"]: r for r in got}
    assert by[1]["disfluent_tokens"] == by[2]["disfluent_tokens"] == by[3]["disfluent_tokens"] == [] and by[5]["annotations"] == []
    words = SENTENCES[0].split()
    assert len([x for x in by[6]["alignment"] if x is not None]) == len(" ".join(SENTENCES * 40).split()) and len(by[6]["annotations"]) > 100 and len([x for x in by[None]["alignment"] if x is not None]) == len(words)
    assert inject.spoken_by_rules(odd.filter("false"), RULES).count() == 0


def test_assignment_is_one_to_one_and_in_order(spark):
    """Two found events contest a gold one, one has the choice of two that are equally near, and one of each side is left."""
    rows = [
        (1, [("filler", 3), ("repair", 4)], [("filler", 4), ("repair", 4), ("filler", 9)]), (2, [("filler", 3), ("repair", 5)], [("repetition", 4)]), (3, [("filler", 2)], [("repair", 3), ("filler", 2)]),
        (4, [], []), (5, [("repair", 1)], []), (6, [], [("filler", 1)]),
    ]
    df = spark.createDataFrame(rows, "k int, g array<struct<type:string,start:int>>, f array<struct<type:string,start:int>>")
    got = {r["k"]: [tuple(p) for p in r["p"]] for r in df.select("k", D.assigned("g", "f").alias("p")).collect()}
    assert got == {
        1: [("repair", "filler"), ("filler", "repair"), ("none", "filler")], 2: [("filler", "repetition"), ("repair", "none")], 3: [("filler", "repair"), ("none", "filler")],
        4: [], 5: [("repair", "none")], 6: [("none", "filler")],
    }


def test_blocks_of_a_batch_are_those_of_each_pair(monkeypatch):
    """Many pairs at once, cut into small parts or not, give what each gives alone; ties, repeats and empty sides included."""
    rng = random.Random(6)
    left = [[rng.choice("abc") for _ in range(rng.randint(0, 14))] for _ in range(300)]
    right = [[rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in range(300)]
    want = [(k, b.a + d, b.b + d) for k, (x, y) in enumerate(zip(left, right)) for b in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks() for d in range(b.size)]
    for held in (2_000_000, 50):
        monkeypatch.setattr(align, "AGREEMENTS", held)
        assert [(p, i + d, j + d) for p, i, j, n in align.blocks(left, right).tolist() for d in range(n)] == want
    assert align.blocks([], []).shape == align.blocks([[]], [["a"]]).shape == (0, 4)


def test_edit_distances_against_the_whole_table():
    rng = random.Random(9)
    for n in (0, 1, 5, 63, 64, 65, 150):
        x, y = [rng.choice("abcd") for _ in range(n)], [rng.choice("abcd") for _ in range(rng.randint(0, 150))]
        row = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            row, before = [i], row
            for j, b in enumerate(y, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (a != b)))
        assert align.edits([x], [y]) == [row[-1]]


def test_trace_and_confusion(spark):
    pairs = spark.createDataFrame([(1, "Carry both boxes.", "carry um both boxes"), (2, "So it goes.", "so it it goes")], "utt_id long, clean string, spoken string")
    d = D.detected(pairs)
    assert sorted(map(tuple, D.trace(d).select("utt_id", "type", "position", "before_clean_word", "words").collect())) == [(1, "filler", 1, 1, "um"), (2, "repetition", 2, 2, "it")]
    assert D.check(D.confusion(d, d)).first()["recall"] == 1.0
    assert evaluate.records(d.selectExpr("*", "0 as asked_level")).count() == 2


def test_rule_generator_is_stable_under_partitioning(spark):
    rows = spark.createDataFrame([(i, s, i % 4) for i, s in enumerate(SENTENCES * 5)], "utt_id long, clean string, asked_level int")
    a = inject.spoken_by_rules(rows.repartition(7), RULES).select("utt_id", "disfluent_tokens").orderBy("utt_id").collect()
    b = inject.spoken_by_rules(rows.coalesce(1), RULES).select("utt_id", "disfluent_tokens").orderBy("utt_id").collect()
    assert a == b
