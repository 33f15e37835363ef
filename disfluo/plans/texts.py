"""Queries of the text layer, of filters, duplicates, samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from disfluo.functions import lexicon as L
from disfluo.functions import text as X
from disfluo.operators import corpus, ordering, parse
from disfluo.plans.rates import said

W = "WITH " + corpus.CORPUS_SQL
STRIP = L.STRIP.replace("'", "''")
AFTER = L.AFTER_CLAUSE.replace("'", "''")
STOP = ", ".join(f"'{w}'" for w in sorted(L.STOPWORD_SET))
NORM = lambda w: f"lower(trim({w}, '{STRIP}'))"
CONTENT = lambda w: f"(length({NORM(w)}) > 3 AND {NORM(w)} NOT IN ({STOP}))"
CLAUSE = lambda w: f"regexp_matches(rtrim({w}, '{AFTER}'), '[,;:]$')"
SPLIT = lambda t: f"list_filter(string_split_regex({t}, '\\s+'), lambda w: w <> '')"
WORDS_ONLY = lambda t: f"array_to_string({SPLIT(f'''lower(regexp_replace({t}, '[^\\pL\\pN\\s'']', '', 'g'))''')}, ' ')"
SPOKEN = lambda t: f"lower(trim(translate({t}, '{L.QUOTES}', ''), '{STRIP}'))"


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null")


def spoken_text(spark, sf_dir):
    return corpus.scripts(spark, sf_dir).select("utt_id", X.spoken_text(F.col("clean")).alias("spoken"))


def canonical_tokens(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", F.size(X.tokens(t)).alias("n_tokens"), F.size(X.canonical_tokens(t)).alias("n_canonical"))


def content_words(spark, sf_dir):
    return corpus.scripts(spark, sf_dir).select("utt_id", F.size(F.filter("clean_tokens", X.is_content)).alias("n_content"))


def clause_onsets(spark, sf_dir):
    ends = F.transform("clean_tokens", lambda w: X.ends_clause(w))
    return corpus.scripts(spark, sf_dir).select("utt_id", (F.lit(1) + F.size(F.filter(F.slice(ends, 1, F.size(ends) - 1), lambda x: x))).alias("n_onsets"))


def words_only(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.words_only(F.col("text")).alias("words"))


def control_token_roundtrip(spark, sf_dir):
    src = X.control_source(F.col("asked_level"), F.col("clean"))
    return corpus.scripts(spark, sf_dir).select("utt_id", src.alias("source")).select("utt_id", "source", X.control_level(F.col("source")).alias("level"))


def detokenised(spark, sf_dir):
    """Texts taken apart at their punctuation and put together again."""
    apart = F.regexp_replace("clean", r"([,.;:!?])", " $1")
    return corpus.scripts(spark, sf_dir).select("utt_id", X.detokenise(apart).alias("text"))


def sentence_filter(spark, sf_dir):
    s = _docs(spark, sf_dir).select("lang", F.explode(X.sentence_split(F.col("text"))).alias("raw")).select("lang", F.trim("raw").alias("raw")).filter("raw <> ''")
    return s.groupBy("lang").agg(F.count("*").alias("sentences"), F.count_if(X.is_usable_sentence(F.col("raw"))).alias("usable"))


def ambiguous_quota(spark, sf_dir, plain: int = 210, ambiguous: int = 90):
    """First come, first served: 30 % of the sample holds an ambiguous word. A limit for each kind keeps both from one task."""
    s = corpus.scripts(spark, sf_dir).select("utt_id", X.has_ambiguous(F.col("clean_tokens")).alias("ambiguous"))
    pick = lambda flag, n: s.filter(F.col("ambiguous") == flag).orderBy("utt_id").limit(n)
    return pick(False, plain).unionByName(pick(True, ambiguous))


def first_occurrence_dedup(spark, sf_dir):
    s = said(spark, sf_dir).select("utt_id", F.array_join("disfluent_tokens", " ").alias("text"))
    return parse.first_occurrence(s, "text", "utt_id").select("utt_id", "copies")


def evaluation_set(spark, sf_dir, size: int = 200):
    """Distinct clean texts in a seeded order, cut to a size."""
    s = parse.first_occurrence(corpus.scripts(spark, sf_dir).filter("n_clean >= 10"), "clean", "utt_id")
    return s.withColumn("h", ordering.seeded("13", "utt_id")).orderBy("h", "utt_id").limit(size).select("utt_id", "clean")


def conversation_split(spark, sf_dir):
    sizes = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("conv_id is not null").groupBy("conv_id").agg(F.count("*").alias("n"))
    return ordering.split_by_conversation(sizes)


def seeded_sample(spark, sf_dir, size: int = 500):
    s = corpus.scripts(spark, sf_dir).select("utt_id", ordering.seeded("13", "utt_id").alias("h"))
    return s.orderBy("h", "utt_id").limit(size)


def pool_cut(spark, sf_dir):
    return ordering.three_way(corpus.scripts(spark, sf_dir).select("utt_id"), "utt_id", "7", 0.8, 0.04).select("utt_id", "split")


def mix_union(spark, sf_dir, real: int = 400):
    """Synthetic pairs and a capped, seeded sample of real ones (here: those at level 3), tagged by source."""
    s = said(spark, sf_dir).select("utt_id", "asked_level", F.array_join("disfluent_tokens", " ").alias("spoken"))
    taken = s.filter("asked_level = 3").orderBy(ordering.seeded("13", "utt_id"), "utt_id").limit(real).withColumn("source", F.lit("real"))
    return s.filter("asked_level < 3").withColumn("source", F.lit("synthetic")).unionByName(taken)


def markup_complete(spark, sf_dir):
    m = corpus.markup(corpus.scripts(spark, sf_dir))
    text = F.when(F.col("utt_id") % 4 == 1, F.regexp_replace("text", "/$", "-/")).when(F.col("utt_id") % 4 == 2, F.regexp_replace("text", " /$", "")).when(F.col("utt_id") % 4 == 3, F.concat(F.lit("[ "), "text")).otherwise(F.col("text"))
    return m.select("utt_id", X.is_complete(text).alias("complete"))


def parse_markup(spark, sf_dir):
    p = parse.utterances(corpus.markup(corpus.scripts(spark, sf_dir)))
    of = lambda t: F.size(F.filter("annotations", lambda a: a.type == t)).alias(f"n_{t}")
    return p.select("utt_id", "status", F.array_join("clean_tokens", " ").alias("clean"), F.array_join("disfluent_tokens", " ").alias("spoken"), *map(of, L.TYPES))


def parse_status(spark, sf_dir):
    """How many units are kept, and why others are not."""
    m = corpus.markup(corpus.scripts(spark, sf_dir)).withColumn("text", F.when(F.col("utt_id") % 5 == 1, F.regexp_replace("text", "/$", "-/")).otherwise(F.col("text")))
    return parse.utterances(m).groupBy("status").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    spoken_text, canonical_tokens, content_words, clause_onsets, words_only, control_token_roundtrip, detokenised, sentence_filter, ambiguous_quota, first_occurrence_dedup,
    evaluation_set, conversation_split, seeded_sample, pool_cut, mix_union, markup_complete, parse_markup, parse_status)}

_AMB = ", ".join(f"'{w}'" for w in L.AMBIGUOUS.split())
_DETOK = r"""trim(regexp_replace(regexp_replace(regexp_replace(array_to_string(list_filter(string_split_regex(translate({0}, '"“”', ''), '\s+'), lambda w: w <> ''), ' '), '(?i)\s+(n''t|''s|''re|''ve|''ll|''d|''m)\b', '\1', 'g'), '\s+([,.;:!?%)\]])', '\1', 'g'), '([(\[$£€])\s+', '\1', 'g'))"""
_BAD = " AND ".join(f"NOT contains(raw, '{b}')" for b in X.BAD_PARTS)
_ABBR = " AND ".join(f"NOT ends_with(sent, '{a}')" for a in X.ABBREVIATIONS)
_MARK = """mk AS (SELECT utt_id, string_agg(CASE kind WHEN 'filler' THEN '{F ' || array_to_string(head, ' ') || ', } ' || word WHEN 'false_start' THEN '[ ' || array_to_string(head, ' ') || ', + ] ' || word
WHEN 'repetition' THEN '[ ' || own || ', + ' || word || ' ]' WHEN 'repair' THEN '[ ' || head[1] || ', + ' || CASE WHEN k > 1 THEN '{E ' || array_to_string(head[2:], ' ') || ', } ' ELSE '' END || word || ' ]' ELSE word END, ' ' ORDER BY i) || ' /' AS text FROM ev GROUP BY utt_id)"""
_H = lambda seed, key: f"md5('{seed}:' || {key})"
ORACLES = {
    "spoken_text": f"{W} SELECT utt_id, array_to_string(list_filter(list_transform(clean_tokens, lambda w: {SPOKEN('w')}), lambda w: w <> ''), ' ') AS spoken FROM scripts",
    "canonical_tokens": f"SELECT doc_id, CAST(len({SPLIT('text')}) AS INTEGER) AS n_tokens, CAST(len(list_filter({SPLIT('text')}, lambda w: regexp_matches(w, '[0-9a-zA-Z]'))) AS INTEGER) AS n_canonical FROM documents WHERE text IS NOT NULL",
    "content_words": f"{W} SELECT utt_id, CAST(len(list_filter(clean_tokens, lambda w: {CONTENT('w')})) AS INTEGER) AS n_content FROM scripts",
    "clause_onsets": f"{W} SELECT utt_id, CAST(1 + len(list_filter(clean_tokens[1:len(clean_tokens) - 1], lambda w: {CLAUSE('w')})) AS INTEGER) AS n_onsets FROM scripts",
    "words_only": f"SELECT doc_id, {WORDS_ONLY('text')} AS words FROM documents WHERE text IS NOT NULL",
    "control_token_roundtrip": f"{W} SELECT utt_id, '<d' || asked_level || '> say aloud: ' || clean AS source, asked_level AS level FROM scripts",
    "detokenised": f"{W} SELECT utt_id, {_DETOK.format(r'''regexp_replace(clean, '([,.;:!?])', ' \1', 'g')''')} AS text FROM scripts",
    "sentence_filter": rf"""WITH s AS (SELECT lang, trim(unnest(string_split(regexp_replace(text, '([.!?])\s+([A-Z"“])', '\1' || chr(10) || '\2', 'g'), chr(10)))) AS raw FROM documents WHERE text IS NOT NULL),
d AS (SELECT lang, raw, {_DETOK.format("raw")} AS sent FROM s WHERE raw <> ''), w AS (SELECT *, {SPLIT("sent")} AS ws FROM d)
SELECT lang, count(*) AS sentences, count(*) FILTER ({_BAD} AND regexp_matches(sent, '^[A-Z]') AND regexp_matches(sent, '[.!?]$') AND len(ws) BETWEEN 5 AND 40 AND regexp_matches(sent, '^[A-Za-z0-9 ,.;:!?''()%&$£€-]+$')
AND NOT regexp_matches(sent, '(^|[^A-Za-z])''|''([^A-Za-z]|$)') AND {_ABBR} AND len(list_filter(ws, lambda w: regexp_matches(w, '^[0-9]'))) <= len(ws) // 3 AND len(list_filter(ws, lambda w: NOT regexp_matches(w, '[0-9a-zA-Z]'))) = 0) AS usable FROM w GROUP BY lang""",
    "ambiguous_quota": f"""{W}, f AS (SELECT utt_id, len(list_filter(clean_tokens, lambda w: lower(trim(w, '.,;:!?"''()')) IN ({_AMB}))) > 0 AS ambiguous FROM scripts),
r AS (SELECT *, row_number() OVER (PARTITION BY ambiguous ORDER BY utt_id) AS n FROM f) SELECT utt_id, ambiguous FROM r WHERE n <= CASE WHEN ambiguous THEN 90 ELSE 210 END""",
    "first_occurrence_dedup": f"{W} SELECT min(utt_id) AS utt_id, count(*) AS copies FROM utt GROUP BY array_to_string(disfluent_tokens, ' ')",
    "evaluation_set": f"{W}, f AS (SELECT clean, min(utt_id) AS utt_id FROM scripts WHERE n_clean >= 10 GROUP BY clean) SELECT utt_id, clean FROM f ORDER BY {_H('13', 'utt_id')}, utt_id LIMIT 200",
    "conversation_split": f"""WITH s AS (SELECT conv_id, count(*) AS n, {_H("13", "conv_id")} AS h FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id), t AS (SELECT sum(n) AS total FROM s),
a AS (SELECT *, coalesce(sum(n) OVER (ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < floor(total * CAST(0.25 AS DOUBLE)) AS held FROM s, t),
b AS (SELECT *, coalesce(sum(CASE WHEN held THEN 0 ELSE n END) OVER (ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a)
SELECT conv_id, n, CASE WHEN held THEN 'eval' WHEN before < floor(total * CAST(0.05 AS DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM b""",
    "seeded_sample": f"{W} SELECT utt_id, {_H('13', 'utt_id')} AS h FROM scripts ORDER BY h, utt_id LIMIT 500",
    "pool_cut": f"""{W}, r AS (SELECT utt_id, row_number() OVER (ORDER BY {_H("7", "utt_id")}) - 1 AS n, count(*) OVER () AS total FROM scripts)
SELECT utt_id, CASE WHEN n < floor(total * CAST(0.8 AS DOUBLE)) THEN 'train' WHEN n < floor(total * CAST(0.8 AS DOUBLE)) + floor(total * CAST(0.04 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM r""",
    "mix_union": f"""{W}, s AS (SELECT utt_id, asked_level, array_to_string(disfluent_tokens, ' ') AS spoken FROM utt)
SELECT *, 'synthetic' AS source FROM s WHERE asked_level < 3 UNION ALL (SELECT *, 'real' AS source FROM s WHERE asked_level = 3 ORDER BY {_H("13", "utt_id")}, utt_id LIMIT 400)""",
    "markup_complete": f"{W} SELECT utt_id, utt_id % 4 = 0 AS complete FROM scripts",
    "parse_markup": f"""{W} SELECT utt_id, 'kept' AS status, array_to_string(clean_tokens, ' ') AS clean, array_to_string(disfluent_tokens, ' ') AS spoken,
{", ".join(f"CAST(n_{t} AS INTEGER) AS n_{t}" for t in L.TYPES)} FROM utt JOIN ms USING (utt_id)""",
    "parse_status": f"{W} SELECT CASE WHEN utt_id % 5 = 1 THEN 'unparsed' ELSE 'kept' END AS status, count(*) AS n FROM scripts GROUP BY 1",
}
