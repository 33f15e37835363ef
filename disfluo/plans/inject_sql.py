"""SQL of the rule injector, for the oracles: candidates by kind, a recursive walk over them, and the words of those taken."""

from __future__ import annotations

from disfluo.functions import lexicon as L
from disfluo.operators import inject as I
from disfluo.plans.texts import CLAUSE, CONTENT, NORM, SPOKEN


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _digits(h: str, part: tuple[int, int]) -> str:
    return f"CAST(('0x' || substr({h}, {part[0]}, {part[1]})) AS BIGINT)"


def _under(h: str, part: tuple[int, int], x: float) -> str:
    return f"{_digits(h, part)} < {x!r} * {16 ** part[1]}.0"


def _index(h: str, part: tuple[int, int], n: str) -> str:
    """From 1."""
    return f"(1 + CAST(floor({_digits(h, part)} * ({n}) / {16 ** part[1]}.0) AS BIGINT))"


_SWAPS = "MAP {" + ", ".join(f"'{w}': {_list(x for x in g if x != w)}" for w, g in L.SWAPS.items()) + "}"
_FRAGMENTS = "[" + ", ".join(_list(f.split()) for f in L.FRAGMENTS) + "]"
_INTERREGNA = "[" + ", ".join(_list(p.split()) for p in L.INTERREGNA) + "]"


def _pause() -> str:
    total, upto, out = sum(w for _, w in L.FILLERS), 0.0, []
    for k, (phrase, _) in enumerate(L.FILLERS[:-1]):
        upto = sum(w for _, w in L.FILLERS[: k + 1])
        out.append(f"WHEN {_under('hf', I.DIGITS['phrase'], round(upto / total, 6))} THEN {_list(phrase.split())}")
    return f"CASE {' '.join(out)} ELSE {_list(L.FILLERS[-1][0].split())} END"


def _want(kind: str, dial: dict[int, I.Rates]) -> str:
    rate = "CASE asked_level " + " ".join(f"WHEN {lv} THEN CAST({getattr(r, kind)!r} AS DOUBLE)" for lv, r in dial.items()) + " ELSE CAST(0 AS DOUBLE) END"
    expected = f"(CASE WHEN n >= {I.LEAST[kind]} THEN greatest({rate} * n / CAST(100 AS DOUBLE), 0) ELSE 0 END)"
    u = f"({_digits(f'md5(key || {chr(39)}:count:{kind}{chr(39)})', I.DIGITS['rank'])} / 4294967296.0)"
    return f"CAST(floor({expected}) AS BIGINT) + CASE WHEN {u} < {expected} - floor({expected}) THEN 1 ELSE 0 END"


def rules_sql(dial: dict[int, I.Rates], source: str = "scripts", seed: int = 13) -> str:
    """Common table expressions from a relation (utt_id, asked_level, clean, clean_tokens): told (one row for each event, with
    its words and its place s on the spoken side) and ruled (one row for each script, with disfluent_tokens and alignment)."""
    lengths = range(2, L.MAX_SPAN + 1)
    span = " UNION ALL ".join(
        f"SELECT key, p, {k} AS k, CASE WHEN {_under('hr', I.DIGITS['longer'], 0.5)} THEN {k} ELSE {-k} END AS o, CASE WHEN {_under('hr', I.DIGITS['drop'], L.SHAPE['span_drop'])} THEN {I.SHORTER} ELSE {I.SWAPPED} END AS how, rank, n FROM usable"
        f" WHERE {_under('hr', I.DIGITS['span'], L.SHAPE['span'])} AND p + {k} <= n AND ({_under('hr', I.DIGITS['drop'], L.SHAPE['span_drop'])} OR {' OR '.join(f'coalesce(counts[p + {d + 1}], 0) > 0' for d in range(k))})"
        for k in lengths
    )
    late = " UNION ALL ".join(f"SELECT key, p, {d} AS d, substr(hm, {4 * (d - I.DELAYS[0]) + 1}, 4) AS o, rank FROM usable WHERE others > 0 AND {_under('hr', I.DIGITS['late'], L.SHAPE['delayed'])} AND p + {d} < n" for d in I.DELAYS)
    fillers = _list(sorted(L.FILLER_WORDS))
    return f"""
r0 AS (SELECT utt_id, asked_level, clean, clean_tokens, CAST(len(clean_tokens) AS BIGINT) AS n, '{seed}:' || utt_id AS key, list_transform(clean_tokens, lambda w: {SPOKEN('w')}) AS said FROM {source}),
want AS (SELECT key, {_want("false_start", dial)} AS w1, {_want("repair", dial)} AS w2, {_want("repetition", dial)} AS w3, {_want("filler", dial)} AS w4 FROM r0),
r1 AS (SELECT key, n, said, clean_tokens, unnest(clean_tokens) AS word, CAST(generate_subscripts(clean_tokens, 1) - 1 AS BIGINT) AS p FROM r0),
r2 AS (SELECT *, CASE WHEN regexp_matches({NORM("word")}, '^[0-9]{{1,15}}$')
    THEN list_transform(list_filter(list_transform([-1, 1, -2, 2, -3, 3, -10, 10], lambda d: CAST({NORM("word")} AS BIGINT) + d), lambda m: m > 0), lambda m: CAST(m AS VARCHAR))
    ELSE coalesce({_SWAPS}[{NORM("word")}], CAST([] AS VARCHAR[])) END AS wrongs,
  {CONTENT("word")} AS content, p = 0 OR coalesce({CLAUSE("clean_tokens[p]")}, false) AS onset,
  md5(key || ':false_start:' || p) AS hs, md5(key || ':repair:' || p) AS hr, md5(key || ':more:' || p) AS hm, md5(key || ':repetition:' || p) AS hp, md5(key || ':filler:' || p) AS hf FROM r1),
places AS (SELECT *, len(wrongs) AS others, list(len(wrongs)) OVER o AS counts, list(content) OVER o AS contents FROM r2 WINDOW o AS (PARTITION BY key ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
starts AS (SELECT key, p, n, row_number() OVER (PARTITION BY key ORDER BY substr(hs, 1, 8), p) AS place FROM places WHERE p >= 1 AND p < n - 3 AND onset),
usable AS (SELECT *, substr(hr, 1, 8) AS rank FROM places WHERE others > 0 OR (p < n - 1 AND len(list_filter(contents[p + 1 : p + 3], lambda c: c)) > 0)),
spans AS ({span}),
lates AS ({late}),
cands AS (
  SELECT key, 1 AS kind, CAST(place AS VARCHAR) AS o1, 0 AS o2, 0 AS o3, '' AS o4, p AS av, least(p + 3, n) AS zv, {I.RESTART} AS how, 0 AS late FROM (
    SELECT key, p, n, lpad(CAST(2 * place AS VARCHAR), 9, '0') AS place FROM starts
    UNION ALL SELECT key, p, n, CASE WHEN {_under('hs', I.DIGITS['phrase'], L.SHAPE['midsentence'])} THEN '000000003' ELSE '000000001' END FROM places WHERE p = 0 AND n >= {I.LEAST["false_start"]})
  UNION ALL SELECT key, 2, rank, p, 1, lpad(CAST(o + 100 AS VARCHAR), 9, '0'), p, p + k, how, 0 FROM spans
  UNION ALL SELECT key, 2, rank, p, 2, o || d, p, p + d + 1, {I.LATE}, d FROM lates
  UNION ALL SELECT key, 2, rank, p, 3, '', p, p + CASE WHEN others > 0 THEN 1 ELSE 2 END, CASE WHEN others > 0 THEN {I.WRONG_WORD} ELSE {I.SHORTER} END, 0 FROM usable WHERE p + CASE WHEN others > 0 THEN 1 ELSE 2 END <= n
  UNION ALL SELECT key, 3, substr(hp, 1, 8), p, 0, '', p, p + k, {I.TWICE}, 0 FROM (SELECT *, CASE WHEN n >= 5 AND {_under('hp', I.DIGITS['phrase'], L.SHAPE['bigram'])} THEN 2 ELSE 1 END AS k FROM places) WHERE p + k <= n
  UNION ALL SELECT key, 4, substr(hf, 1, 8), p, 0, '', p, p, {I.PAUSE}, 0 FROM places WHERE (onset OR content) AND len(list_intersect(said[greatest(p, 1) : p + 2], {fillers})) = 0),
queue AS (SELECT key, list({{'kind': kind, 'av': av, 'zv': zv, 'how': how, 'late': late}} ORDER BY kind, o1, o2, o3, o4) AS q FROM cands JOIN want USING (key) WHERE [w1, w2, w3, w4][kind] > 0 GROUP BY key),
walk AS (
  SELECT key, q, [w1, w2, w3, w4] AS lft, CAST(1 AS BIGINT) AS step, q[1:0] AS taken FROM queue JOIN want USING (key)
  UNION ALL
  SELECT key, q, CASE WHEN goes THEN list_transform(lft, lambda x, i: x - CASE WHEN i = c.kind THEN 1 ELSE 0 END) ELSE lft END, step + 1, CASE WHEN goes THEN list_append(taken, c) ELSE taken END FROM (
    SELECT *, lft[c.kind] > 0 AND len(list_filter(taken, lambda e: e.av < greatest(c.zv, c.av + 1) AND e.zv > c.av)) = 0 AS goes FROM (SELECT *, q[step] AS c FROM walk WHERE step <= len(q)))),
chosen AS (SELECT key, unnest(taken) AS e FROM walk WHERE step = len(q) + 1),
ch AS (SELECT chosen.key AS key, e.av AS av, e.zv AS zv, e.how AS how, e.late AS late, p.* EXCLUDE (key) FROM chosen JOIN places p ON p.key = chosen.key AND p.p = chosen.e.av),
f2 AS (SELECT *, zv - av AS k, list_filter({_FRAGMENTS}, lambda f: array_to_string(f, ' ') <> array_to_string(list_transform(clean_tokens[av + 1 : av + 2], lambda w: {NORM('w')}), ' ')) AS frags,
  list_filter(range(av, greatest(zv, av + 1)), lambda x: counts[x + 1] > 0) AS qs FROM ch),
f3 AS (SELECT *, {_index('hm', I.MORE['gone'], 'k - 1')} AS gone, qs[{_index('hm', I.MORE['place'], 'len(qs)')}] AS q FROM f2),
f4 AS (SELECT f3.*, o.wrongs[{_index('o.hr', I.DIGITS['word'], 'len(o.wrongs)')}] AS other FROM f3 LEFT JOIN places o ON o.key = f3.key AND o.p = CASE WHEN f3.how = {I.SWAPPED} THEN f3.q ELSE f3.av END),
told AS (SELECT key, av, zv, how, late,
  CASE how WHEN {I.RESTART} THEN frags[{_index('hs', I.DIGITS['phrase'], 'len(frags)')}] WHEN {I.SHORTER} THEN said[av + 1 : av + gone] || said[av + gone + 2 : zv] WHEN {I.SWAPPED} THEN said[av + 1 : q] || [other] || said[q + 2 : zv]
    WHEN {I.WRONG_WORD} THEN [other] WHEN {I.LATE} THEN [other] WHEN {I.TWICE} THEN said[av + 1 : zv] ELSE CAST([] AS VARCHAR[]) END AS wrong,
  CASE WHEN how = {I.PAUSE} THEN {_pause()} WHEN how = {I.LATE} OR (how BETWEEN {I.SHORTER} AND {I.LATE} AND {_under('hr', I.DIGITS['edit'], L.SHAPE['interregnum'])}) THEN {_INTERREGNA}[{_index('hm', I.MORE['said'], str(len(L.INTERREGNA)))}] ELSE CAST([] AS VARCHAR[]) END AS edit FROM f4),
pieces AS (SELECT pl.key, pl.p, CASE WHEN a.av IS NULL THEN CAST([] AS VARCHAR[]) WHEN a.late > 0 THEN a.wrong ELSE a.wrong || a.edit END AS head, coalesce(a.late, 0) = 0 AS own, pl.said[pl.p + 1] AS word, b.edit AS back, b.av AS back_at, pl.said[b.av + 1] AS back_word
  FROM places pl LEFT JOIN told a ON a.key = pl.key AND a.av = pl.p LEFT JOIN told b ON b.key = pl.key AND b.late > 0 AND b.av + b.late = pl.p),
ruled AS (SELECT r0.utt_id, r0.asked_level, r0.clean, r0.clean_tokens, r0.n, x.disfluent_tokens, x.alignment FROM r0 JOIN (
  SELECT key, flatten(list(head || CASE WHEN own THEN [word] ELSE CAST([] AS VARCHAR[]) END || CASE WHEN back IS NULL THEN CAST([] AS VARCHAR[]) ELSE back || [back_word] END ORDER BY p)) AS disfluent_tokens,
    flatten(list(list_transform(head, lambda x: CAST(NULL AS BIGINT)) || CASE WHEN own THEN [p] ELSE CAST([] AS BIGINT[]) END || CASE WHEN back IS NULL THEN CAST([] AS BIGINT[]) ELSE list_transform(back, lambda x: CAST(NULL AS BIGINT)) || [back_at] END ORDER BY p)) AS alignment
  FROM pieces GROUP BY key) x USING (key)),
nevents AS (SELECT key, count(*) AS events, count(*) FILTER (how = {I.PAUSE}) AS n_filler, count(*) FILTER (how = {I.TWICE}) AS n_repetition, count(*) FILTER (how BETWEEN {I.SHORTER} AND {I.LATE}) AS n_repair, count(*) FILTER (how = {I.RESTART}) AS n_false_start,
  CAST(sum(len(wrong) + len(edit)) AS BIGINT) AS inserted FROM told GROUP BY key),
rms AS (SELECT r0.utt_id, r0.asked_level, r0.n AS n_clean, coalesce(events, 0) AS n_events, coalesce(inserted, 0) AS inserted, coalesce(n_filler, 0) AS n_filler, coalesce(n_repetition, 0) AS n_repetition, coalesce(n_repair, 0) AS n_repair, coalesce(n_false_start, 0) AS n_false_start,
  coalesce(events, 0) * (100.0 / CAST(r0.n AS DOUBLE)) AS rate FROM r0 LEFT JOIN nevents USING (key))"""
