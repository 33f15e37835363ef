"""SQL of the detector, for the oracles: longest block first, then the runs between blocks taken apart."""

from __future__ import annotations

from disfluo.functions import lexicon as L
from disfluo.operators.detect import EDITING
from disfluo.plans.texts import CLAUSE, CONTENT, NORM, SPOKEN

_PHRASES = "|".join(sorted((p for p, _ in L.FILLERS), key=lambda p: -len(p.split())))
_OPENERS = ", ".join("'" + w + "'" for w in sorted(L.OPENER_SET))
_WORDS = lambda text: f"list_filter(string_split({text}, ' '), lambda w: w <> '')"


def _edit(part: str) -> str:
    """Place or length of the first editing phrase of a core (null without any): longer phrases first, then the leftmost."""
    out = "NULL"
    for p in reversed(EDITING):
        value = f"len({_WORDS(f'''split_part(' ' || core || ' ', ' {' '.join(p)} ', 1)''')})" if part == "place" else str(len(p))
        out = f"CASE WHEN contains(' ' || core || ' ', ' {' '.join(p)} ') THEN {value} ELSE {out} END"
    return out


#: Needs pairs(utt_id, asked_level, a, b): the script's words as spoken and the spoken words. Gives blocks, gaps (stretches between
#: blocks: clean words i to i2, spoken words j to j2) and found, one row for each event, with its place k.
DETECT_SQL = f"""
aw AS (SELECT utt_id, unnest(a) AS w, generate_subscripts(a, 1) - 1 AS i FROM pairs),
bw AS (SELECT utt_id, unnest(b) AS w, generate_subscripts(b, 1) - 1 AS j FROM pairs),
eq AS MATERIALIZED (SELECT utt_id, i, j FROM aw JOIN bw USING (utt_id, w)),
win AS (
  SELECT utt_id, CAST(0 AS BIGINT) AS alo, CAST(len(a) AS BIGINT) AS ahi, CAST(0 AS BIGINT) AS blo, CAST(len(b) AS BIGINT) AS bhi, CAST(-1 AS BIGINT) AS bi, CAST(-1 AS BIGINT) AS bj, CAST(0 AS BIGINT) AS bk FROM pairs
  UNION ALL
  SELECT utt_id, alo, ahi, blo, bhi, bi, bj, bk FROM (
    SELECT *, row_number() OVER (PARTITION BY utt_id, alo, ahi, blo, bhi ORDER BY bk DESC, bi, bj) AS place FROM (
      SELECT utt_id, alo, ahi, blo, bhi, min(i) AS bi, min(j) AS bj, count(*) AS bk FROM (
        SELECT t.*, i, j, i - row_number() OVER (PARTITION BY utt_id, alo, ahi, blo, bhi, j - i ORDER BY i) AS run
        FROM (SELECT utt_id, CASE WHEN side = 0 THEN alo ELSE bi + bk END AS alo, CASE WHEN side = 0 AND bk > 0 THEN bi ELSE ahi END AS ahi, CASE WHEN side = 0 THEN blo ELSE bj + bk END AS blo, CASE WHEN side = 0 AND bk > 0 THEN bj ELSE bhi END AS bhi
              FROM win, (VALUES (0), (1)) s(side) WHERE side = 0 OR bk > 0) t JOIN eq USING (utt_id)
        WHERE i >= alo AND i < ahi AND j >= blo AND j < bhi) GROUP BY utt_id, alo, ahi, blo, bhi, j - i, run)) WHERE place = 1),
blocks AS (SELECT utt_id, bi, bj, bk FROM win WHERE bk > 0 UNION ALL SELECT utt_id, len(a), len(b), 0 FROM pairs),
gaps AS (SELECT utt_id, coalesce(lag(bi + bk) OVER o, 0) AS i, bi AS i2, coalesce(lag(bj + bk) OVER o, 0) AS j, bj AS j2 FROM blocks WINDOW o AS (PARTITION BY utt_id ORDER BY bi, bj, bk DESC)),
lost AS (SELECT utt_id, CAST(sum(i2 - i) AS BIGINT) AS dropped FROM gaps GROUP BY utt_id),
r1 AS (SELECT utt_id, asked_level, a, b, i2 AS at_word, j, array_to_string(b[j + 1 : j2], ' ') || ' ' AS run FROM gaps JOIN pairs USING (utt_id) WHERE j < j2),
r2 AS (SELECT *, regexp_extract(run, '^(?:(?:{_PHRASES}) )*') AS head FROM r1),
r3 AS (SELECT *, regexp_extract(' ' || substr(run, length(head) + 1), '(?: (?:{_PHRASES}))* $') AS tail FROM r2),
r4 AS (SELECT *, {_WORDS("head")} AS hw, {_WORDS("tail")} AS tw, trim(substr(run, length(head) + 1, greatest(0, length(run) - length(head) - length(tail)))) AS core FROM r3),
r5 AS (SELECT *, {_WORDS("core")} AS cw, j + len(hw) AS lo FROM r4),
fl AS (SELECT utt_id, asked_level, a, b, at_word, unnest(ps) AS p, generate_subscripts(ps, 1) AS n, ps, start FROM (
  SELECT utt_id, asked_level, a, b, at_word, regexp_extract_all(head, '(?:{_PHRASES})') AS ps, j AS start FROM r5 UNION ALL
  SELECT utt_id, asked_level, a, b, at_word, regexp_extract_all(tail, '(?:{_PHRASES})'), lo + len(cw) FROM r5)),
pieces AS (
  SELECT utt_id, asked_level, a, b, at_word, 'filler' AS type, start + coalesce(len({_WORDS("array_to_string(ps[1 : n - 1], ' ')")}), 0) AS x, len({_WORDS("p")}) AS size, NULL AS edit_at, NULL AS edit_len FROM fl
  UNION ALL
  SELECT utt_id, asked_level, a, b, at_word, CASE WHEN edit_at IS NOT NULL THEN 'repair' WHEN b[lo + len(cw) + 1 : lo + 2 * len(cw)] = cw OR (lo >= len(cw) AND b[lo - len(cw) + 1 : lo] = cw) THEN 'repetition'
    WHEN len(cw) <= {L.MAX_RESTART} AND (lo = 0 OR at_word = 0) AND len(list_filter(cw, lambda w: w NOT IN ({_OPENERS}))) = 0 THEN 'false_start' ELSE 'repair' END, lo, len(cw), edit_at, edit_len
  FROM (SELECT *, {_edit("place")} AS edit_at, {_edit("length")} AS edit_len FROM r5 WHERE core <> '')),
found AS (SELECT utt_id, asked_level, a, b, type, at_word, CAST(x AS INTEGER) AS first, CAST(CASE WHEN edit_at IS NULL THEN x + size ELSE x + edit_at + edit_len END AS INTEGER) AS past,
  row_number() OVER (PARTITION BY utt_id ORDER BY CASE WHEN type = 'filler' THEN x WHEN edit_at IS NOT NULL THEN x + edit_at ELSE x + size END, x) - 1 AS k FROM pieces)"""

PAIRS_SQL = f"pairs AS (SELECT utt_id, asked_level, list_transform(clean_tokens, lambda w: {SPOKEN('w')}) AS a, disfluent_tokens AS b FROM utt)"

#: Columns of an event that placement looks at, from found.
RECORDS_SQL = f"""frec AS (SELECT f.utt_id, f.asked_level, CAST(k AS INTEGER) AS k, type, past - first AS length, CAST(at_word AS INTEGER) AS clean_index, at_word / CAST(len(clean_tokens) AS DOUBLE) AS relative,
coalesce({NORM("clean_tokens[at_word + 1]")}, '') AS next_word, coalesce({CONTENT("clean_tokens[at_word + 1]")}, false) AS next_is_content, at_word = 0 OR coalesce({CLAUSE("clean_tokens[at_word]")}, false) AS at_onset
FROM found f JOIN scripts USING (utt_id))"""

#: Found events take, in their order, the nearest free gold event within one word, the first of equally near ones.
CONFUSION_SQL = """
gl AS (SELECT utt_id, list({'type': type, 'at': s} ORDER BY i) AS g FROM ann GROUP BY utt_id),
fd AS (SELECT utt_id, list({'type': type, 'at': first} ORDER BY k) AS f FROM found GROUP BY utt_id),
both_ AS (SELECT utt_id, coalesce(g, []) AS g, coalesce(f, []) AS f FROM gl FULL JOIN fd USING (utt_id)),
walk AS (
  SELECT utt_id, g, f, 0 AS step, CAST([] AS INTEGER[]) AS used, CAST(NULL AS INTEGER) AS got FROM both_
  UNION ALL
  SELECT utt_id, g, f, step + 1, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, pick FROM (
    SELECT *, CAST(coalesce(list_filter(near, lambda x: g[x].at = f[step + 1].at)[1], near[1]) AS INTEGER) AS pick FROM (
      SELECT *, list_filter(range(1, len(g) + 1), lambda x: NOT list_contains(used, CAST(x AS INTEGER)) AND abs(g[x].at - f[step + 1].at) <= 1) AS near FROM walk WHERE step < len(f)))),
cells AS (SELECT gold, found, count(*) AS n FROM (
  SELECT coalesce(g[got].type, 'none') AS gold, f[step].type AS found FROM walk WHERE step > 0
  UNION ALL SELECT unnest(list_filter(g, lambda x, i: NOT list_contains(used, CAST(i AS INTEGER)))).type, 'none' FROM walk WHERE step = len(f)) GROUP BY ALL)"""
