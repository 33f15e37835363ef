"""The rule injector: a script rendered as disfluent speech at given rates, with its annotations.

What may happen at a place, and in which order places are tried, comes from md5 digits of seed, utterance and place alone,
so the same row gets the same speech under any partitioning and in any engine that has md5. All of it is Column expressions:
the places of each kind are an array, ordered by their digits; a fold walks over it and takes what is still free there, as many
events as the kind's rate asks for; the words of the events chosen are then put between the script's. Nothing crosses rows.

Kinds that hold more words choose first: restarts, repairs, repetitions, fillers. A candidate is a struct of its kind's place
(at), the first word past those that it holds (past), how it comes about, and the words after which a late correction follows.
No two events hold one word, so a place has one event at most.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from disfluo.functions import lexicon as L
from disfluo.functions.text import canonical_tokens, ends_clause, is_content, normalise, spoken_form
from disfluo.operators.corpus import ANNOTATION, SPAN


@dataclass(frozen=True)
class Rates:
    """Events for each 100 clean words."""

    filler: float = 0.0
    repetition: float = 0.0
    repair: float = 0.0
    false_start: float = 0.0


#: How an event comes about.
RESTART, SHORTER, SWAPPED, WRONG_WORD, LATE, TWICE, PAUSE = range(7)
KIND_OF = ("false_start", "repair", "repair", "repair", "repair", "repetition", "filler")

#: Least words of a script in which a kind occurs.
LEAST = {"false_start": 6, "repair": 1, "repetition": 3, "filler": 1}

#: (first digit, digits) of a place's digests: which part says what. ``repair`` has a second digest, ``more``.
DIGITS = {"rank": (1, 8), "phrase": (9, 8), "span": (9, 4), "longer": (13, 1), "drop": (14, 4), "word": (18, 4), "late": (22, 4), "edit": (26, 4)}
MORE = {"place": (21, 4), "gone": (25, 4), "said": (29, 4)}
DELAYS = tuple(range(2, L.MAX_DELAY + 1))

_CANDIDATE = "struct<at:int,past:int,how:int,late:int>"
_NONE = "array<string>"


def below(x: float, digits: int) -> str:
    """Hexadecimal digits that just those of numbers under x come before."""
    return format(ceil(x * 16**digits), f"0{digits}x")


def _under(digest: Column, part: tuple[int, int], x: float) -> Column:
    return F.substring(digest, *part) < F.lit(below(x, part[1]))


def _index(digest: Column, part: tuple[int, int], n: Column) -> Column:
    """A place in a list of n, by the digits of a part."""
    return F.floor(F.conv(F.substring(digest, *part), 16, 10).cast("long") * n / F.lit(float(16 ** part[1]))).cast("int")


def _words(phrases) -> Column:
    return F.array(*[F.array(*map(F.lit, p.split())) for p in phrases])


def alternatives(key: Column) -> Column:
    """Wrong words of the same kind as a normalised word: the others of its group, or nearby numbers; none for most words."""
    groups = F.create_map(*[x for word, group in L.SWAPS.items() for x in (F.lit(word), F.array(*[F.lit(w) for w in group if w != word]))])
    number = key.cast("long")
    near = F.filter(F.transform(F.array(*[F.lit(d) for d in (-1, 1, -2, 2, -3, 3, -10, 10)]), lambda d: number + d), lambda m: m > 0)
    listed = F.when(key.isin(*sorted(L.SWAPS)), F.try_element_at(groups, key))  # a set is asked before the map, which is walked
    return F.when(key.rlike("^[0-9]{1,15}$"), F.transform(near, lambda m: m.cast("string"))).otherwise(F.coalesce(listed, F.array().cast(_NONE)))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once for each row: exploding an array of one element keeps it from being computed again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _candidate(at: Column, past: Column, how: int, late: Column | int = 0) -> Column:
    return F.struct(at.cast("int").alias("at"), past.cast("int").alias("past"), F.lit(how).alias("how"), (F.lit(late) if isinstance(late, int) else late).cast("int").alias("late")).cast(_CANDIDATE)


def _places(n: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda p: p < n)


def _ranked(places: Column, digest: Callable[[Column], Column]) -> Column:
    """Places by their digits: structs (rank, p, h)."""
    hashed = F.transform(places, lambda p: F.struct(p.alias("p"), digest(p).alias("h")))
    return F.array_sort(F.transform(hashed, lambda x: F.struct(F.substring(x.h, *DIGITS["rank"]).alias("rank"), x.p.alias("p"), x.h.alias("h"))))


def _restarts(n: Column, onset: Column, digest: Callable) -> tuple[Column, Callable]:
    """Clause starts with three words after them; the sentence's start first, or one place later where the speech breaks off midway."""
    inner = _ranked(F.filter(_places(n), lambda p: (p >= 1) & (p < n - 3) & F.get(onset, p)), digest)
    first = F.when((F.size(inner) > 0) & _under(digest(F.lit(0)), DIGITS["phrase"], L.SHAPE["midsentence"]), 1).otherwise(0)
    at = F.transform(inner, lambda r: r.p)
    order = F.concat(F.slice(at, F.lit(1), first), F.array(F.lit(0)), F.slice(at, first + 1, F.size(at)))
    return order, lambda p: F.array(_candidate(p, F.least(p + 3, n), RESTART))


def _usable(n: Column, others: Column, content: Column) -> Column:
    """Where a repair may stand: at a word with another that it could be, or near a content word."""
    return F.filter(_places(n), lambda p: (F.get(others, p) > 0) | ((p < n - 1) & F.exists(F.slice(content, p + 1, F.lit(3)), lambda c: c)))


def _repairs(n: Column, others: Column, usable: Column, digest: Callable, more: Callable) -> tuple[Column, Callable]:
    """At each place a few words said with one left out or swapped, or else one word said wrong, with its correction at once or late."""
    other, any_in = (lambda p: F.get(others, p) > 0), lambda flags, p, k: F.exists(F.slice(flags, p + 1, k), lambda x: x > 0)

    def options(r: Column) -> Column:
        p, h = r.p, r.h

        def span(k: int) -> Column:
            fits = p + k <= n
            return F.when(fits & _under(h, DIGITS["drop"], L.SHAPE["span_drop"]), _candidate(p, p + k, SHORTER)).when(fits & any_in(others, p, F.lit(k)), _candidate(p, p + k, SWAPPED))

        lengths = [span(k) for k in range(2, L.MAX_SPAN + 1)]
        spans = F.when(_under(h, DIGITS["longer"], 0.5), F.array(*lengths)).otherwise(F.array(*lengths[::-1]))
        spans = F.when(_under(h, DIGITS["span"], L.SHAPE["span"]), spans).otherwise(F.array().cast(f"array<{_CANDIDATE}>"))
        delay = lambda d: F.struct(F.substring(more(p), 4 * (d - DELAYS[0]) + 1, 4).alias("rank"), F.lit(d).alias("d"))
        delays = F.transform(F.filter(F.array_sort(F.array(*map(delay, DELAYS))), lambda d: p + d.d < n), lambda d: _candidate(p, p + d.d + 1, LATE, d.d))
        delays = F.when(_under(h, DIGITS["late"], L.SHAPE["delayed"]), delays).otherwise(F.array().cast(f"array<{_CANDIDATE}>"))
        word = F.when(other(p), F.concat(delays, F.array(_candidate(p, p + 1, WRONG_WORD)))).otherwise(F.array(_candidate(p, p + 2, SHORTER)))
        return F.concat(F.filter(spans, lambda c: c.isNotNull()), F.filter(word, lambda c: c.past <= n))

    return _ranked(usable, digest), options


def _repetitions(n: Column, digest: Callable) -> tuple[Column, Callable]:
    def option(r: Column) -> Column:
        two = (n >= 5) & _under(r.h, DIGITS["phrase"], L.SHAPE["bigram"])
        return F.filter(F.array(_candidate(r.p, r.p + F.when(two, 2).otherwise(1), TWICE)), lambda c: c.past <= n)

    return _ranked(_places(n), digest), option


def _fit(n: Column, said: Column, onset: Column, content: Column) -> Column:
    """Where a filled pause may stand: at an onset or before a content word; not beside a word that could be one."""
    beside = lambda p: F.exists(F.slice(said, F.greatest(p, F.lit(1)), F.when(p == 0, 2).otherwise(3)), lambda w: w.isin(*sorted(L.FILLER_WORDS)))
    return F.filter(_places(n), lambda p: (F.get(onset, p) | F.get(content, p)) & ~beside(p))


def _pauses(fit: Column, digest: Callable) -> tuple[Column, Callable]:
    """A filled pause holds no word."""
    return _ranked(fit, digest), lambda r: F.array(_candidate(r.p, r.p, PAUSE))


def _taken(places: Column, options: Callable[[Column], Column], want: Column, held: Column) -> Column:
    """held with a candidate of each of the first places that have a free one, as many as wanted; a pause, which holds no word, needs the
    word after it. A place's options (all of them hold its word, so one is taken at most) are worked out when it is reached."""

    def step(state: Column, place: Column) -> Column:
        free = lambda c: ~F.exists(state.events, lambda e: (e.at < F.greatest(c.past, c.at + 1)) & (e.past > c.at))
        first = F.slice(F.filter(options(place), free), F.lit(1), F.lit(1))
        more = F.transform(F.array(first), lambda c: F.struct((state.left - F.size(c)).alias("left"), F.concat(state.events, c).alias("events")))
        return F.when(state.left > 0, F.get(more, F.lit(0))).otherwise(state)

    return F.aggregate(places, F.struct(want.alias("left"), held.alias("events")), step, lambda s: s.events)


def _digests(seed: int, key: str) -> Callable:
    uid = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return lambda kind: lambda p: F.md5(F.concat_ws(":", F.lit(str(seed)), uid, F.lit(kind), p.cast("string")).cast("binary"))


def _wanted(dial: dict[int, Rates], level: str, digest: Callable) -> dict[str, Column]:
    """How many events of each kind a row asks for."""
    n = F.col("n_clean")

    def wanted(kind: str) -> Column:
        rate = F.lit(0.0)
        for lv, rates in dial.items():
            rate = F.when(F.col(level) == lv, F.lit(float(getattr(rates, kind)))).otherwise(rate)
        expected = F.when(n >= LEAST[kind], F.greatest(rate * n / F.lit(100.0), F.lit(0.0))).otherwise(0.0)
        u = F.conv(F.substring(digest("count")(F.lit(kind)), *DIGITS["rank"]), 16, 10).cast("double") / F.lit(4294967296.0)
        more = (expected > F.floor(expected)) & (u < expected - F.floor(expected))  # a whole number needs no digest
        return (F.floor(expected).cast("int") + F.when(more, 1).otherwise(0)).alias(kind)

    return {kind: wanted(kind) for kind in LEAST}


def _lower(words: pa.Array) -> pa.Array:
    low, odd = pc.utf8_lower(words), pc.invert(pc.string_is_ascii(words))
    return pc.replace_with_mask(low, odd, pa.array([w.lower() for w in words.filter(odd).to_pylist()], pa.string())) if pc.any(odd).as_py() else low


def _traits(column: pa.Array) -> pa.Array:
    """What ``planned`` asks of each script's words by themselves, for a batch at once, on flat arrays of its words."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    words = column.flatten().cast(pa.string())
    ends, own = np.cumsum(sizes), np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(own)) - np.repeat(ends - sizes, sizes)
    flags = lambda x: pc.fill_null(x, False).to_numpy(zero_copy_only=False)
    among = lambda x, those: flags(pc.is_in(x, value_set=pa.array(sorted(those), pa.string())))

    def near(x: np.ndarray, d: int) -> np.ndarray:
        """The flags of the words d places on; none beyond the script."""
        out = np.zeros(len(x), dtype=bool)
        if d > 0:
            out[:-d] = x[d:] & (own[:-d] == own[d:])
        else:
            out[-d:] = x[:d] & (own[-d:] == own[:d])
        return out

    keys = _lower(pc.utf8_trim(words, L.STRIP))
    quoted = flags(pc.match_substring_regex(words, f"[{L.QUOTES}]")).any()
    said = _lower(pc.utf8_trim(pc.replace_substring_regex(words, f"[{L.QUOTES}]", ""), L.STRIP)) if quoted else keys
    pause = among(said, L.FILLER_WORDS)
    content = (pc.fill_null(pc.utf8_length(keys), 0).to_numpy() > 3) & ~among(keys, L.STOPWORD_SET)
    others = among(keys, L.SWAPS) | flags(pc.match_substring_regex(keys, "^[0-9]{1,15}$"))
    onset = (place == 0) | near(flags(pc.match_substring_regex(pc.utf8_rtrim(words, L.AFTER_CLAUSE), "[,;:]$")), -1)
    usable = others | ((place < np.repeat(sizes, sizes) - 1) & (content | near(content, 1) | near(content, 2)))
    fit = (onset | content) & ~(pause | near(pause, 1) | near(pause, -1))
    lists = lambda x, n: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(x))
    held = lambda x: lists(place[x].astype(np.int32), np.bincount(own[x], minlength=len(sizes)))
    columns = [lists(others.astype(np.int32), sizes), lists(onset, sizes), held(usable), held(fit)]
    return pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(columns, _TRAITS)], fields=list(_TRAITS))


#: Of a script's words: others (1 where another could be meant) and onset; the places usable for repairs and fit for pauses.
TRAITS = T.StructType([T.StructField("others", T.ArrayType(T.IntegerType())), T.StructField("onset", T.ArrayType(T.BooleanType())), *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("usable", "fit")]])
_TRAITS = to_arrow_schema(TRAITS)
traits_udf = F.arrow_udf(_traits, TRAITS)


def traits(scripts: DataFrame) -> DataFrame:
    """Scripts with _others, _onset, _usable and _fit, which ``counted`` asks for: they don't depend on level and key, so they are worked
    out once for all renderings."""
    out = scripts.withColumn("_t", traits_udf("clean_tokens"))
    return out.select(*scripts.columns, *[F.col(f"_t.{c}").alias(f"_{c}") for c in TRAITS.names])


def counted(scripts: DataFrame, dial: dict[int, Rates], seed: int = 13, level: str = "asked_level", key: str = "utt_id") -> DataFrame:
    """Scripts (clean_tokens, n_clean, with ``traits``) with n_events, how many events ``spoken_by_rules`` gives them.

    A kind gets all the events that it asks for where it has more places than the events before could take away; such rows, most of
    them, need no place's digest. In the others the events that hold words are taken one by one; pauses hold none, so as many are
    taken as asked for or as places are left.
    """
    n, digest = F.col("n_clean"), _digests(seed, key)
    out = scripts.withColumns({f"_n_{kind}": w for kind, w in _wanted(dial, level, digest).items()})
    restarts, repairs, twice, pauses = wants = [F.col(f"_n_{kind}") for kind in LEAST]
    # words that an event holds at most; places are tried with two words at most in the end, so an event takes a place more than it has words
    long = F.when(F.array_contains("_others", 1), max(L.MAX_SPAN, L.MAX_DELAY + 1)).otherwise(L.MAX_SPAN)
    taken = lambda r, s: r * 4 + s * (long + 1)
    enough = (
        (restarts <= 1) & ((repairs == 0) | (F.size("_usable") > taken(restarts, repairs - 1))) & ((twice == 0) | (n - 1 > taken(restarts, repairs) + (twice - 1) * 3))
        & ((pauses == 0) | (F.size("_fit") >= pauses + restarts * 3 + repairs * long + twice * 2))
    )
    candidates = [
        _restarts(n, F.col("_onset"), digest("false_start")), _repairs(n, F.col("_others"), F.col("_usable"), digest("repair"), digest("more")), _repetitions(n, digest("repetition")),
    ]
    free = lambda p, held: ~F.exists(held, lambda e: (e.at <= p) & (e.past > p))
    held = F.array(F.array().cast(f"array<{_CANDIDATE}>"))  # one element, so that the next step's fold has it as a value
    for (places, options), want in zip(candidates, wants):
        held = F.transform(held, lambda x: F.when(want > 0, _taken(places, options, want, x)).otherwise(x))  # noqa: B023  called at once
    one_by_one = F.get(F.transform(held, lambda x: F.size(x) + F.least(pauses, F.size(F.filter("_fit", lambda p: free(p, x))))), F.lit(0))
    count = F.when(enough, restarts + repairs + twice + pauses).otherwise(one_by_one)
    return out.select(*[c for c in scripts.columns if c not in [f"_{t}" for t in TRAITS.names]], count.cast("long").alias("n_events"))


def planned(scripts: DataFrame, dial: dict[int, Rates], seed: int, level: str, key: str) -> DataFrame:
    """Scripts (clean_tokens, n_clean) with said, others (counts of alternatives) and events (candidates taken, by place)."""
    n, digest = F.col("n_clean"), _digests(seed, key)
    out = _once(scripts, "said", F.transform("clean_tokens", spoken_form))
    out = _once(out, "_want", F.struct(*_wanted(dial, level, digest).values()))
    asked = lambda *kinds: sum((F.col(f"_want.{k}") for k in kinds), F.lit(0)) > 0  # noqa: E731  what no kind asks for is not worked out
    none, flags = F.array().cast(f"array<{_CANDIDATE}>"), F.array().cast("array<boolean>")
    out = _once(out, "wrongs", F.when(asked("repair"), F.transform(F.transform("clean_tokens", normalise), alternatives)).otherwise(F.array().cast(f"array<{_NONE}>")))
    out = _once(out, "others", F.transform("wrongs", lambda w: F.size(w)))
    out = _once(out, "content", F.when(asked("repair", "filler"), F.transform("clean_tokens", is_content)).otherwise(flags))
    out = _once(out, "onset", F.when(asked("false_start", "filler"), F.transform("clean_tokens", lambda w, p: (p == 0) | ends_clause(F.get("clean_tokens", p - 1)))).otherwise(flags))
    candidates = {
        "false_start": _restarts(n, F.col("onset"), digest("false_start")), "repair": _repairs(n, F.col("others"), _usable(n, F.col("others"), F.col("content")), digest("repair"), digest("more")),
        "repetition": _repetitions(n, digest("repetition")), "filler": _pauses(_fit(n, F.col("said"), F.col("onset"), F.col("content")), digest("filler")),
    }
    out = out.withColumn("events", none)
    for kind, (places, options) in candidates.items():
        out = _once(out, "_events", F.when(F.col(f"_want.{kind}") > 0, _taken(places, options, F.col(f"_want.{kind}"), F.col("events"))).otherwise(F.col("events")))
        out = out.withColumn("events", F.col("_events")).drop("_events")
    out = out.drop("_want")
    return out.withColumn("events", F.array_sort("events"))


def _phrased(e: Column, n: Column, seed: int, key: str) -> Column:
    """An event with its words: wrong (said and taken back) and edit (said in between)."""
    uid = F.coalesce(F.col(key).cast("string"), F.lit(""))
    digest = lambda kind, p: F.md5(F.concat_ws(":", F.lit(str(seed)), uid, F.lit(kind), p.cast("string")).cast("binary"))
    said, k, none = F.col("said"), e.past - e.at, F.array().cast(_NONE)
    repair, more = digest("repair", e.at), digest("more", e.at)
    begun = F.array_join(F.transform(F.slice("clean_tokens", e.at + 1, F.lit(2)), normalise), " ")
    fragments = F.filter(_words(L.FRAGMENTS), lambda f: F.array_join(f, " ") != begun)
    fragment = F.get(fragments, _index(digest("false_start", e.at), DIGITS["phrase"], F.size(fragments)))
    gone = _index(more, MORE["gone"], k - 1) + 1
    shorter = F.concat(F.slice(said, e.at + 1, gone), F.slice(said, e.at + gone + 2, F.greatest(k - gone - 1, F.lit(0))))
    places = F.filter(F.sequence(e.at, F.greatest(e.past - 1, e.at)), lambda q: F.get("others", q) > 0)
    q = F.get(places, _index(more, MORE["place"], F.size(places)))
    wrong_at = lambda p: F.array(F.get(F.get("wrongs", p), _index(digest("repair", p), DIGITS["word"], F.get("others", p))))
    swapped = F.concat(F.slice(said, e.at + 1, q - e.at), wrong_at(q), F.slice(said, q + 2, F.greatest(e.past - q - 1, F.lit(0))))
    editing = F.get(_words(L.INTERREGNA), _index(more, MORE["said"], F.lit(len(L.INTERREGNA))))
    edit = F.when((e.how == LATE) | _under(repair, DIGITS["edit"], L.SHAPE["interregnum"]), editing).otherwise(none)
    pause = digest("filler", e.at)
    filler, total = F.array(*map(F.lit, L.FILLERS[-1][0].split())), sum(w for _, w in L.FILLERS)
    upto = total
    for phrase, weight in reversed(L.FILLERS[:-1]):
        upto = sum(w for _, w in L.FILLERS[: [p for p, _ in L.FILLERS].index(phrase) + 1])
        filler = F.when(_under(pause, DIGITS["phrase"], round(upto / total, 6)), F.array(*map(F.lit, phrase.split()))).otherwise(filler)
    wrong = (
        F.when(e.how == RESTART, fragment).when(e.how == SHORTER, shorter).when(e.how == SWAPPED, swapped).when(e.how.isin(WRONG_WORD, LATE), wrong_at(e.at))
        .when(e.how == TWICE, F.slice(said, e.at + 1, k)).otherwise(none)
    )
    return F.struct(e.at.alias("at"), e.past.alias("past"), e.how.alias("how"), e.late.alias("late"), wrong.alias("wrong"), F.when(e.how == PAUSE, filler).when(e.how.between(SHORTER, LATE), edit).otherwise(none).alias("edit"))


def spoken_by_rules(scripts: DataFrame, dial: dict[int, Rates], seed: int = 13, level: str = "asked_level", key: str = "utt_id") -> DataFrame:
    """Scripts in the corpus schema with speech at each row's level; rows at level 0 (no rates) are the spoken text itself.

    A null or empty script is said with no word; rows with equal keys and texts are said alike; a null key counts as the empty text.
    """
    out = scripts.withColumn("clean_tokens", F.coalesce(canonical_tokens(F.col("clean")), F.array().cast(_NONE))).withColumn("n_clean", F.size("clean_tokens"))
    keep = out.columns
    n, span, none = F.col("n_clean"), (lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end")).cast(SPAN)), F.lit(None).cast(SPAN)
    inner = {c: f"_x{k}" for k, c in enumerate(keep) if c not in ("clean_tokens", "n_clean", key, level)}  # whatever the other columns are called
    out = out.select(*[F.col(f"`{c}`").alias(inner.get(c, c)) for c in keep])
    e = _once(planned(out, dial, seed, level, key), "told", F.transform("events", lambda x: _phrased(x, n, seed, key)))
    at = lambda i: F.get(F.filter("told", lambda x: x.at == i), F.lit(0))
    back = lambda i: F.get(F.filter("told", lambda x: (x.late > 0) & (x.at + x.late == i)), F.lit(0))
    e = _once(e, "here", F.transform("said", lambda w, i: F.struct(at(i).alias("e"), back(i).alias("b"))))
    empty, gap = F.array().cast(_NONE), (lambda words: F.array_repeat(F.lit(None).cast("int"), F.size(words)))
    head = lambda x: F.when(x.e.isNull(), empty).when(x.e.late > 0, x.e.wrong).otherwise(F.concat(x.e.wrong, x.e.edit))
    held = lambda x: F.coalesce(x.e.late > 0, F.lit(False))
    tokens = F.transform("here", lambda x, i: F.concat(head(x), F.when(held(x), empty).otherwise(F.array(F.get("said", i))), F.when(x.b.isNull(), empty).otherwise(F.concat(x.b.edit, F.array(F.get("said", x.b.at))))))
    places = F.transform("here", lambda x, i: F.concat(gap(head(x)), F.when(held(x), F.array().cast("array<int>")).otherwise(F.array(i.cast("int"))), F.when(x.b.isNull(), F.array().cast("array<int>")).otherwise(F.concat(gap(x.b.edit), F.array(x.b.at)))))

    def note(x: Column, j: Column) -> Column:
        s = F.aggregate(F.slice("told", F.lit(1), j), x.at, lambda a, y: a + F.size(y.wrong) + F.size(y.edit))
        w, d = F.size(x.wrong), F.size(x.edit)
        edit_at = s + w + x.late
        fix = F.when(x.how == PAUSE, none).when(x.how == RESTART, span(s + w, s + w + F.least(F.lit(3), n - x.at))).when(x.late > 0, span(edit_at + d, edit_at + d + 1)).otherwise(span(s + w + d, s + w + d + x.past - x.at))
        kind = F.get(F.array(*map(F.lit, KIND_OF)), x.how)
        return F.struct(kind.alias("type"), F.when(w > 0, span(s, s + w)).alias("reparandum"), F.when(d > 0, span(edit_at, edit_at + d)).alias("interregnum"), fix.alias("repair")).cast(ANNOTATION)

    done = e.select(*[inner.get(c, c) for c in keep], F.flatten(tokens).alias("_d"), F.flatten(places).alias("_a"), F.transform("told", note).alias("_n"))
    made = {"disfluent_tokens": "_d", "alignment": "_a", "annotations": "_n"}
    return done.select(*[F.col(inner.get(c, c)).alias(c) for c in keep if c not in made], *[F.col(v).alias(k) for k, v in made.items()])
