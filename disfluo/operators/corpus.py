"""Scripts from the documents table, and a spoken side with known annotations.

The hash injector decides at each word, by a digest that depends only on the seed, the utterance and the position, whether a
filled pause, a repetition, a substitution or (at the start) a restart goes before it. It works within the row, so it needs
no shuffle, and any engine with md5 gets the same corpus. A word costs one digest: its first eight hexadecimal digits decide
on the event, the next eight on its words, the next eight on an editing phrase.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from disfluo.functions import lexicon as L
from disfluo.functions.text import sentence_split, spoken_form

#: By asked level: probability at a word of a filled pause, a repetition and a substitution, and at the start of a restart.
DIAL = {0: (0.0, 0.0, 0.0, 0.0), 1: (0.045, 0.008, 0.01, 0.02), 2: (0.09, 0.02, 0.03, 0.06), 3: (0.18, 0.05, 0.06, 0.12)}
WRONG = L.SWAP_GROUPS[7].split()
#: A script: a capital first, a stop last, and words of these characters, each with a letter or digit. What matched is not tried again, so one pass decides.
SCRIPT = r"^[A-Z][A-Za-z0-9,.;:!?'-]*+(?: ++[,.;:!?'-]*+[0-9A-Za-z][A-Za-z0-9,.;:!?'-]*+)*+(?<=[.!?])\z"
SPAN = "struct<start:int,end:int>"
ANNOTATION = f"struct<type:string,reparandum:{SPAN},interregnum:{SPAN},repair:{SPAN}>"


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the md5 of the parts."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def spread(df: DataFrame) -> DataFrame:
    """df on as many partitions as there are cores, where a table of few row groups would leave cores idle; large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scripts(spark: SparkSession, sf_dir: str, level: int | None = None) -> DataFrame:
    """utt_id, doc_id, clean, clean_tokens, n_clean and asked_level of the English documents' sentences of 5 to 40 words; those of one
    level alone are told by their number, before their text is looked at."""
    asked = F.floor(uniform("level", F.col("utt_id")) * 4).cast("int")
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").filter("lang = 'en' and text is not null").select("doc_id", "text"))
    sents = docs.select("doc_id", F.posexplode(sentence_split(F.col("text"))).alias("pos", "raw"))
    out = sents.select((F.col("doc_id") * 1000000 + F.col("pos")).alias("utt_id"), "doc_id", F.trim("raw").alias("clean"))
    out = (out if level is None else out.filter(asked == level)).filter(F.col("clean").rlike(SCRIPT))
    words = F.array_remove(F.split("clean", " "), "")
    out = out.select("*", F.explode(F.array(words)).alias("clean_tokens"))  # one element, so words are cut once
    out = out.withColumn("n_clean", F.size("clean_tokens")).filter(F.col("n_clean").between(5, 40))
    return out.withColumn("asked_level", asked)


def _below(p: float) -> str:
    """Hexadecimal digits such that a digest sorts before them if the number in [0, 1) that its first eight make is less than p."""
    return f"{math.ceil(p * (1 << 32)):08x}"


def _pick(options: list, u: Column) -> Column:
    return F.get(F.array(*[F.array(*map(F.lit, o.split())) for o in options]), F.floor(u * len(options)).cast("int"))


def _filler(digits: Column) -> Column:
    out, left = F.array(*map(F.lit, L.FILLERS[-1][0].split())), sum(w for _, w in L.FILLERS)
    for phrase, weight in reversed(L.FILLERS):
        left -= weight
        words = F.array(*map(F.lit, phrase.split()))
        out = words if phrase == L.FILLERS[-1][0] else F.when(digits < _below(round(left + weight, 3)), words).otherwise(out)
    return out


KINDS = ("filler", "repetition", "repair", "false_start")


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once for each row: one element of an array, exploded."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _late(x: Column) -> Column:
    return (x.i == 0) & F.col("dial.begins")


def _picked(scripted: DataFrame, seed: str | Column) -> DataFrame:
    """The scripts with dial (the limits of their level) and picked, the words that an event goes before: i and the word's digest h."""

    def limit(k: int) -> Column:
        """By level: digits below which events of the first k + 1 kinds lie."""
        out = F.lit(_below(0.0))
        for lv, row in DIAL.items():
            out = F.when(F.col("asked_level") == lv, F.lit(_below(sum(row[: k + 1]) if k < 3 else row[3]))).otherwise(out)
        return out

    own = F.lit(seed) if isinstance(seed, str) else seed
    key = F.concat_ws(":", own, F.col("utt_id").cast("string"))
    begins = (F.col("n_clean") >= 6) & (F.md5(F.concat_ws(":", own, F.lit("start"), F.col("utt_id").cast("string")).cast("binary")) < limit(3))
    out = _once(scripted, "dial", F.struct(key.alias("key"), begins.alias("begins"), *[limit(k).alias(KINDS[k]) for k in range(3)]))
    hashed = F.transform("clean_tokens", lambda w, i: F.struct(i.cast("int").alias("i"), F.md5(F.concat_ws(":", "dial.key", i.cast("string")).cast("binary")).alias("h")))
    picked = F.filter(hashed, lambda x: (x.h < F.col("dial.repair")) | _late(x))
    calm = ~F.col("dial.begins") & (F.col("dial.repair") <= _below(0.0))
    return out.withColumn("picked", F.when(calm, F.array().cast("array<struct<i:int,h:string>>")).otherwise(picked))  # used once


def counted(scripted: DataFrame, seed: str = "say") -> DataFrame:
    """The scripts with n_events, how many events their spoken side has; nothing else of it is worked out."""
    return _picked(scripted, seed).withColumn("n_events", F.size("picked").cast("long")).drop("dial", "picked")


def planned(scripted: DataFrame, seed: str | Column = "say") -> DataFrame:
    """The scripts with their events: kind (its place in KINDS), i (the word that it goes before), and its words, k of them.

    A word costs one digest and one comparison; all else is worked out for the few words with an event alone.
    """

    def kind(x: Column) -> Column:
        return F.struct(F.when(_late(x), 3).when(x.h < F.col("dial.filler"), 0).when(x.h < F.col("dial.repetition"), 1).otherwise(2).alias("kind"), x.i.alias("i"), x.h.alias("h"))

    def words(x: Column) -> Column:
        v, w = (F.substring(x.h, at, 8) for at in (9, 17))
        number = F.conv(v, 16, 10).cast("double") / F.lit(4294967296.0)
        edit = F.when(w < _below(L.SHAPE["interregnum"]), F.array(F.lit("i"), F.lit("mean"))).otherwise(F.array().cast("array<string>"))
        wrong = F.get(F.array(*map(F.lit, WRONG)), F.floor(number * len(WRONG)).cast("int"))
        own = F.array(spoken_form(F.get("clean_tokens", x.i)))
        head = F.when(x.kind == 0, _filler(v)).when(x.kind == 1, own).when(x.kind == 2, F.concat(F.array(wrong), edit)).otherwise(_pick(list(L.FRAGMENTS), number))
        return F.struct(x.kind.alias("kind"), x.i.alias("i"), head.alias("words"))

    sized = lambda x: F.struct(x.kind.alias("kind"), x.i.alias("i"), F.size(x.words).alias("k"), x.words.alias("words"))
    return _once(_picked(scripted, seed), "events", F.transform(F.transform(F.transform("picked", kind), words), sized)).drop("dial", "picked")


def _between(events: str, here: Callable[[Column, Column], Column], last: Callable[[Column], Column]) -> Column:
    """Of the stretches of words before each event, with the event, and of the one after the last event: what here and last make of them, in a row."""
    past = lambda e: F.coalesce(e.i, F.lit(0))
    each = F.transform(events, lambda e, j: here(past(F.get(events, j - 1)), e))
    return F.flatten(F.concat(each, F.array(last(past(F.get(events, F.size(events) - 1))))))


def spoken(scripted: DataFrame, seed: str | Column = "say", *keep: str, own: str | None = None) -> DataFrame:
    """The scripts with a spoken side: disfluent_tokens, alignment (null at inserted words) and annotations; and with columns to be kept.
    own names a column with the words' spoken forms, if there is one."""
    out, n = planned(scripted, seed), F.size("clean_tokens")
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    none = F.lit(None).cast(SPAN)

    def place(e: Column, j: Column) -> Column:
        """The event with the place on the spoken side where it starts."""
        before = F.aggregate(F.slice("events", F.lit(1), j), e.i, lambda a, x: a + x.k)
        return F.struct(e.kind.alias("kind"), before.alias("s"), e.k.alias("k"))

    def note(e: Column) -> Column:
        s, k, fill, late = e.s, e.k, e.kind == 0, e.kind == 3
        rep = F.when(late, span(s, s + k)).when(fill, none).otherwise(span(s, s + 1))
        inter = F.when(fill, span(s, s + k)).when((e.kind == 2) & (k > 1), span(s + 1, s + k))
        fix = F.when(fill, none).when(late, span(s + k, s + k + F.least(F.lit(3), F.col("n_clean")))).otherwise(span(s + k, s + k + 1))
        return F.struct(F.get(F.array(*map(F.lit, KINDS)), e.kind).alias("type"), rep.alias("reparandum"), inter.alias("interregnum"), fix.alias("repair")).cast(ANNOTATION)

    run = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))
    script = own or "clean_tokens"
    words = _between("events", lambda p, e: F.concat(F.slice(script, p + 1, e.i - p), e.words), lambda p: F.slice(script, p + 1, n - p))
    said = F.when(F.size("events") == 0, F.col(script)).otherwise(words)
    said = said if own else F.transform(said, spoken_form)  # the events' words are spoken forms already
    places = _between("events", lambda p, e: F.concat(run(p, e.i), F.array_repeat(F.lit(None).cast("int"), e.k)), lambda p: run(p, n))
    align = F.when(F.size("events") == 0, run(F.lit(0), n)).otherwise(places)
    notes = F.transform(F.transform("events", place), note)
    return out.select(*keep, "utt_id", "doc_id", "asked_level", "clean", "clean_tokens", "n_clean", said.alias("disfluent_tokens"), align.alias("alignment"), notes.alias("annotations"))


def markup(scripted: DataFrame, seed: str = "say") -> DataFrame:
    """utt_id and the spoken side as annotated transcript text, ending in a slash."""
    comma = lambda words: F.concat(F.array_join(words, " "), F.lit(","))

    def at(word: Column, i: Column) -> Column:
        event = F.get(F.filter("events", lambda e: e.i == i), F.lit(0))
        kind, head = event.kind, event.words
        edit = F.when(F.size(head) > 1, F.concat(F.lit("{E "), comma(F.slice(head, F.lit(2), F.size(head))), F.lit(" } "))).otherwise(F.lit(""))
        return (
            F.when(kind.isNull(), word).when(kind == 0, F.concat(F.lit("{F "), comma(head), F.lit(" } "), word)).when(kind == 3, F.concat(F.lit("[ "), comma(head), F.lit(" + ] "), word))
            .when(kind == 1, F.concat(F.lit("[ "), comma(head), F.lit(" + "), word, F.lit(" ]")))
            .otherwise(F.concat(F.lit("[ "), comma(F.slice(head, F.lit(1), F.lit(1))), F.lit(" + "), edit, word, F.lit(" ]")))
        )

    return planned(scripted, seed).select("utt_id", F.concat(F.array_join(F.transform("clean_tokens", at), " "), F.lit(" /")).alias("text"))


def _sql_list(words: str) -> str:
    return "[" + ", ".join("'" + w + "'" for w in words.split()) + "]"


def _sql_filler() -> str:
    total, out = 0.0, []
    for phrase, weight in L.FILLERS[:-1]:
        total += weight
        out.append(f"WHEN v < {round(total, 3)} THEN {_sql_list(phrase)}")
    return "CASE " + " ".join(out) + f" ELSE {_sql_list(L.FILLERS[-1][0])} END"


def _sql_rate(k: int) -> str:
    return "CASE asked_level " + " ".join(f"WHEN {lv} THEN {sum(row[: k + 1]) if k < 3 else row[3]!r}" for lv, row in DIAL.items()) + " END"


def sql_uniform(*parts: str) -> str:
    text = " || ':' || ".join(parts)
    return f"(CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT) / 4294967296.0)"


def sql_digits(at: int) -> str:
    return f"(CAST(('0x' || substr(h, {at}, 8)) AS BIGINT) / 4294967296.0)"


STRIP_SQL = L.STRIP.replace("'", "''")

#: Common table expressions of the scripts.
SCRIPTS_SQL = rf"""
sl AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+([A-Z"“])', '\1' || chr(10) || '\2', 'g'), chr(10)) AS s FROM documents WHERE lang = 'en' AND text IS NOT NULL),
sn AS (SELECT doc_id, unnest(s) AS raw, generate_subscripts(s, 1) - 1 AS pos FROM sl),
sc AS (SELECT doc_id * 1000000 + pos AS utt_id, doc_id, trim(raw) AS clean FROM sn WHERE regexp_matches(trim(raw), '^[A-Z][A-Za-z0-9 ,.;:!?''-]*[.!?]$')),
st AS (SELECT *, list_filter(string_split_regex(clean, '\s+'), lambda w: w <> '') AS clean_tokens FROM sc),
scripts AS (SELECT *, CAST(len(clean_tokens) AS INTEGER) AS n_clean, CAST(floor({sql_uniform("'level'", "utt_id")} * 4) AS INTEGER) AS asked_level FROM st
  WHERE len(clean_tokens) BETWEEN 5 AND 40 AND len(list_filter(clean_tokens, lambda w: NOT regexp_matches(w, '[0-9a-zA-Z]'))) = 0)"""

_SPOKEN_SQL = rf"""
wd AS (SELECT utt_id, asked_level, n_clean, unnest(clean_tokens) AS word, generate_subscripts(clean_tokens, 1) - 1 AS i FROM scripts),
du AS (SELECT *, lower(trim(translate(word, '{L.QUOTES}', ''), '{STRIP_SQL}')) AS own, {sql_digits(1)} AS u, {sql_digits(9)} AS v, {sql_digits(17)} AS w, {sql_uniform("'say'", "'start'", "utt_id")} AS b
  FROM (SELECT *, md5('say:' || utt_id || ':' || i) AS h FROM wd)),
dk AS (SELECT *, CASE WHEN i = 0 AND n_clean >= 6 AND b < {_sql_rate(3)} THEN 'false_start' WHEN u < {_sql_rate(0)} THEN 'filler' WHEN u < {_sql_rate(1)} THEN 'repetition' WHEN u < {_sql_rate(2)} THEN 'repair' END AS kind FROM du),
dh AS (SELECT *, CASE kind WHEN 'filler' THEN {_sql_filler()} WHEN 'repetition' THEN [own]
  WHEN 'repair' THEN [{_sql_list(" ".join(WRONG))}[CAST(floor(v * {len(WRONG)}) AS INTEGER) + 1]] || CASE WHEN w < {L.SHAPE["interregnum"]} THEN ['i', 'mean'] ELSE CAST([] AS VARCHAR[]) END
  WHEN 'false_start' THEN [{", ".join(_sql_list(f) for f in L.FRAGMENTS)}][CAST(floor(v * {len(L.FRAGMENTS)}) AS INTEGER) + 1] ELSE CAST([] AS VARCHAR[]) END AS head FROM dk),
ev AS (SELECT *, CAST(len(head) AS INTEGER) AS k, CAST(coalesce(sum(len(head) + 1) OVER (PARTITION BY utt_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS s FROM dh),
ann AS (SELECT utt_id, asked_level, n_clean, i, kind AS type, head, s,
  CASE kind WHEN 'filler' THEN NULL ELSE s END AS rep_s, CASE kind WHEN 'filler' THEN NULL WHEN 'false_start' THEN s + k ELSE s + 1 END AS rep_e,
  CASE WHEN kind = 'filler' THEN s WHEN kind = 'repair' AND k > 1 THEN s + 1 END AS int_s, CASE WHEN kind = 'filler' OR (kind = 'repair' AND k > 1) THEN s + k END AS int_e,
  CASE kind WHEN 'filler' THEN NULL ELSE s + k END AS fix_s, CASE kind WHEN 'filler' THEN NULL WHEN 'false_start' THEN s + k + least(3, n_clean) ELSE s + k + 1 END AS fix_e
  FROM ev WHERE kind IS NOT NULL),
said AS (SELECT utt_id, flatten(list(head || [own] ORDER BY i)) AS disfluent_tokens,
  flatten(list(list_transform(head, lambda x: CAST(NULL AS INTEGER)) || [CAST(i AS INTEGER)] ORDER BY i)) AS alignment FROM ev GROUP BY utt_id),
utt AS (SELECT scripts.*, disfluent_tokens, alignment FROM scripts JOIN said USING (utt_id)),
ms AS (SELECT utt_id, asked_level, doc_id, n_clean, coalesce(f, 0) AS n_filler, coalesce(r, 0) AS n_repetition, coalesce(p, 0) AS n_repair, coalesce(e, 0) AS n_false_start, coalesce(t, 0) AS n_events, coalesce(ins, 0) AS inserted,
  coalesce(t, 0) * (100.0 / CAST(n_clean AS DOUBLE)) AS rate
  FROM scripts LEFT JOIN (SELECT utt_id, count(*) FILTER (type = 'filler') AS f, count(*) FILTER (type = 'repetition') AS r, count(*) FILTER (type = 'repair') AS p,
    count(*) FILTER (type = 'false_start') AS e, count(*) AS t, CAST(sum(coalesce(rep_e - rep_s, 0) + coalesce(int_e - int_s, 0)) AS BIGINT) AS ins FROM ann GROUP BY utt_id) USING (utt_id))"""


def spoken_sql(tag: str = "", source: str = "scripts", seed: str = "say") -> str:
    """Common table expressions of a spoken side of scripts: ev (one row for each word), utt (one for each utterance), ann (one
    for each annotation) and ms (measures); with a tag after their names."""
    named = re.sub(r"\b(wd|du|dk|dh|ev|ann|said|utt|ms)\b", rf"\1{tag}", _SPOKEN_SQL.replace("'say", f"'{seed}"))
    return re.sub(r"\bscripts\b", source, named)


#: The corpus: scripts with their spoken side.
CORPUS_SQL = SCRIPTS_SQL + "," + spoken_sql()
