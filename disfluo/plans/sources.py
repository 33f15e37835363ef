"""Queries of sources and sinks: what is written comes back, and pools are built from templates and sentences."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from disfluo.functions import lexicon as L
from disfluo.functions import text as X
from disfluo.functions.templates import TEMPLATES, VALUES
from disfluo.operators import corpus, inject, levels, measure, ordering, pools
from disfluo.plans.rates import CUTS_SQL, LEVEL_SQL, SUMS_SQL, UNI_KEY, UNI_SQL, W, measured, rates_sql, said
from disfluo.plans.texts import _ABBR, _AMB, _BAD, _DETOK, _H, SPLIT, SPOKEN
from disfluo.sources import io


def scratch(spark: SparkSession) -> str:
    """A new folder that the driver and the executors share; one of this machine only where Spark runs in one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp()}"
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"


def utterances(spark, sf_dir):
    """The corpus in the layout of its files."""
    s = said(spark, sf_dir)
    return s.withColumn("disfluent", F.array_join("disfluent_tokens", " ")).withColumn("source", F.lit("transcript")).withColumn("conversation", F.col("doc_id").cast("string"))


def jsonl_roundtrip(spark, sf_dir):
    """Rates by level of the corpus, written as JSON lines and read again."""
    path = scratch(spark)
    io.write_jsonl(utterances(spark, sf_dir), path)
    back = io.read_jsonl(spark, path).withColumn("n_clean", F.size("clean_tokens")).withColumn("doc_id", F.col("conversation").cast("long"))
    return measure.summary(["asked_level"], measure.measure(back))


def transcript_statuses(spark, sf_dir):
    """Transcripts written as CSV files, read and parsed: how many units are kept, and why others are not."""
    path = scratch(spark)
    marked = corpus.markup(corpus.scripts(spark, sf_dir))
    text = F.when(F.col("utt_id") % 5 == 1, F.regexp_replace("text", "/$", "-/")).when(F.col("utt_id") % 5 == 2, F.lit("So it goes /")).when(F.col("utt_id") % 5 == 3, F.lit("It is said again and again /")).otherwise(F.col("text"))
    marked.select(text.alias("text"), F.lit("1").alias("conversation_no")).write.option("header", True).option("escape", '"').csv(path)
    return io.parse_counts(io.load_utterances(spark, path))


def transcript_layouts(spark, sf_dir):
    """Transcripts in files of three layouts in one folder, one of them without a text, one with its columns the other way round and
    line ends in cells, read by each file's own header: units, conversations and characters by layout."""
    path = scratch(spark)
    marked = corpus.markup(corpus.scripts(spark, sf_dir)).withColumn("number", (F.col("utt_id") % 7).cast("string"))
    text, other = F.col("text"), F.regexp_replace("text", "^([^ ]+) ", "$1\n")
    layouts = ((text.alias("text"), F.col("number").alias("conversation_no")), (F.col("number").alias("conversation_no"), F.lit("a, b").alias("act"), other.alias("text")), (text.alias("words"), F.col("number").alias("conversation_no")))
    for k, columns in enumerate(layouts):
        marked.filter(F.col("utt_id") % 3 == k).select(*columns).write.option("header", True).option("escape", '"').csv(f"{path}/layout{k}")
    rows = io.read_transcripts(spark, path).withColumn("layout", F.regexp_extract("file", "layout([0-9])", 1).cast("int"))
    return rows.groupBy("layout", "conversation_no").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("characters"), F.sum(F.when(F.contains("text", F.lit("\n")), 1).otherwise(0)).alias("with_line_end"))


def level_settings(spark, sf_dir):
    """The level table written as a specification, read again, and turned into targets and injector rates."""
    path = scratch(spark)
    m = measured(spark, sf_dir)
    io.write_levels(measure.level_table(m), measure.percentile_cuts(m), path)
    spec = io.read_levels(spark, path)
    rows = [(k, *[getattr(levels.rates(spec, k), t) for t in L.TYPES], levels.targets(spec, k)["total"], *[float(levels.mix(spec, k)[t]) for t in L.TYPES]) for k in levels.LEVELS]
    return spark.createDataFrame(rows, "level int, " + ", ".join(f"{t} double" for t in (*L.TYPES, "total", *[f"mix_{t}" for t in L.TYPES])))


def frequencies_roundtrip(spark, sf_dir):
    path = scratch(spark)
    io.write_frequencies(measure.unigrams(corpus.scripts(spark, sf_dir)), path)
    return io.read_frequencies(spark, path, required=True)


def generations_roundtrip(spark, sf_dir):
    """Generations by system and level, written and read again with the folders' names as columns."""
    path = scratch(spark)
    rows = said(spark, sf_dir).select("utt_id", F.array_join("disfluent_tokens", " ").alias("spoken"), F.lit("injector").alias("system"), F.col("asked_level").alias("level"))
    io.write_generations(rows, path)
    return io.read_generations(spark, path).groupBy("system", "level").agg(F.count("*").alias("n"), F.sum(F.length("spoken")).alias("characters"))


def generations_of_systems(spark, sf_dir):
    """One system's generations written, another's beside them twice: each is there once."""
    path, s = scratch(spark), corpus.scripts(spark, sf_dir)
    for system, seed in (("first", "say"), ("second", "run"), ("second", "run")):
        rows = corpus.spoken(s, seed).select("utt_id", F.array_join("disfluent_tokens", " ").alias("spoken"), F.lit(system).alias("system"), F.col("asked_level").alias("level"))
        io.write_generations(rows, path)
    return io.read_generations(spark, path).groupBy("system", "level").agg(F.count("*").alias("n"), F.sum(F.length("spoken")).alias("characters"))


def report_roundtrip(spark, sf_dir):
    """A report written with one table, patched with a second one, and read: its tables and their rows."""
    path = scratch(spark)
    m = measured(spark, sf_dir)
    io.write_report({"rates": measure.summary(["asked_level"], m).select("asked_level", "events")}, path)
    io.patch_report(measure.summary([], m).select("events"), "totals", path)
    rows = [(name, r.get("asked_level", -1), r["events"]) for name, table in io.read_report(spark, path).items() for r in table]
    return spark.createDataFrame(rows, "name string, asked_level int, events long")


def training_pairs(spark, sf_dir):
    """Pairs written, read with the three fields that training needs, and put behind their control tokens."""
    path = scratch(spark)
    io.write_jsonl(utterances(spark, sf_dir).withColumn("level", F.col("asked_level")), path)
    return io.training_rows(io.load_pairs(spark, path))


def real_pairs(spark, sf_dir):
    """Annotated pairs labelled by their own rate at the published cuts."""
    path = scratch(spark)
    io.write_jsonl(utterances(spark, sf_dir), path)
    return io.real_pairs(spark, path, 10.0, 21.42857142857143).select("utt_id", "n_clean", "level")


def typed_lines(spark, sf_dir):
    """Lines of messages as they are typed: blank ones dropped, the rest stripped and numbered."""
    return io.lines_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn")


def sentence_source(spark, sf_dir, limit: int = 300):
    """Sentences of the documents: a table that is not there is passed over, plain ones come first, 30 % are ambiguous."""
    return io.sentence_source(spark, [f"{sf_dir}/larger.parquet", f"{sf_dir}/documents.parquet"], limit)


def template_sentences(spark, sf_dir, each: int = 20):
    """Fillings of the templates, with their different words and how many of these the documents' scripts hold."""
    t = pools.template_sentences(spark, each=each)
    words = t.select("template_id", "text", F.explode(F.array_distinct(F.transform(X.tokens(F.col("text")), X.unigram_key))).alias("word"))
    held = measure.unigrams(corpus.scripts(spark, sf_dir)).select("word", F.lit(1).alias("held"))
    return words.join(held, "word", "left").groupBy("template_id", "text").agg(F.count("*").alias("words"), F.count("held").alias("known"))


def source_pools(spark, sf_dir, each: int = 20):
    """Distinct scripts and template sentences in train, val and test, with a fifth of the templates held out."""
    return pools.build_pools(corpus.scripts(spark, sf_dir).select(F.col("clean").alias("text")), pools.template_sentences(spark, each=each))


def balanced_generation(spark, sf_dir, each: int = 60):
    """Every script said at every level by the hash injector, relabelled by the corpus's cuts, and drawn level by level."""
    asked = corpus.scripts(spark, sf_dir).filter(F.col("n_clean") >= L.MIN_WORDS).withColumn("sentence", F.col("utt_id")).withColumn("asked_level", F.explode(F.array(*map(F.lit, range(4)))))
    pairs = corpus.spoken(asked.withColumn("utt_id", F.col("utt_id") * 4 + F.col("asked_level")), "draw")
    m = measure.with_level(measure.measure(pairs).withColumn("sentence", F.expr("utt_id div 4")), measure.percentile_cuts(measured(spark, sf_dir)))
    return pools.balanced(m.select("utt_id", "sentence", "asked_level", "level"), "sentence", "13", each)


def training_mix(spark, sf_dir, limit: int = 400):
    """Levels and sources of the training mix without real pairs, with some of them, and with all."""
    s = said(spark, sf_dir).select("utt_id", F.col("asked_level").alias("level"))
    out = None
    for n in (0, limit, -1):
        mixed = io.mix_real(s.filter("level < 3"), s.filter("level = 3"), n)
        spread = mixed.groupBy(F.lit(n).alias("real"), "source", "level").agg(F.count("*").alias("pairs"), F.min("h").alias("first"))
        out = spread if out is None else out.unionByName(spread)
    return out


def repairs_per_split(spark, sf_dir):
    """Utterances, conversations and repairs of each split; a document is a conversation."""
    m = measured(spark, sf_dir)
    by = m.groupBy(F.col("doc_id").alias("conv_id")).agg(F.count("*").alias("n"), F.sum("n_repair").alias("repairs"))
    split = ordering.split_by_conversation(by.select("conv_id", "n"))
    return by.join(split.select("conv_id", "split"), "conv_id").groupBy("split").agg(F.sum("n").alias("utterances"), F.count("*").alias("conversations"), F.sum("repairs").alias("repairs"))


def annotation_types(spark, sf_dir):
    return said(spark, sf_dir).select(F.explode("annotations").alias("a")).groupBy(F.col("a.type").alias("type")).agg(F.count("*").alias("n"))


def word_spans(spark, sf_dir):
    s = corpus.scripts(spark, sf_dir).select("utt_id", F.posexplode(X.word_spans(F.col("clean"))).alias("word", "s"))
    return s.select("utt_id", "word", F.col("s.start").alias("start"), F.col("s.end").alias("end"))


def folded_scores(spark, sf_dir):
    """Pieces of three characters, each worth its place's number in bits, folded into words."""
    s = corpus.scripts(spark, sf_dir)
    n = F.ceil(F.length("clean") / 3).cast("int")
    piece = lambda k: F.struct((3 * k).alias("start"), F.least(3 * k + 3, F.length("clean")).alias("end"), (k % 7).cast("double").alias("bits"))
    s = s.select("utt_id", "clean", F.explode(F.array(F.transform(F.sequence(F.lit(0), n - 1), piece))).alias("pieces"))
    return X.fold_to_words(s, "clean", "pieces").select("utt_id", F.posexplode("bits").alias("word", "bits"))


def surprisal_bits(spark, sf_dir):
    """Bits of the first of four scores made from an utterance's length."""
    n = F.col("n_clean").cast("double")
    s = corpus.scripts(spark, sf_dir).select("utt_id", F.array(n / 10, F.lit(0.0), -n, F.lit(1.5)).alias("scores"))
    return s.select("utt_id", F.round(X.surprisal_bits(F.col("scores"), F.lit(0)), 9).alias("bits"))


def annotations_json(spark, sf_dir):
    """Annotations as JSON text and back."""
    s = said(spark, sf_dir).select("utt_id", F.to_json("annotations").alias("text"))
    back = s.select("utt_id", F.from_json("text", f"array<{corpus.ANNOTATION}>").alias("a"))
    return back.select("utt_id", F.size("a").alias("n"), F.size(F.filter("a", lambda x: x.interregnum.isNotNull())).alias("with_interregnum"))


def structural_events(spark, sf_dir):
    """Events of each utterance that are no fillers."""
    return measured(spark, sf_dir).select("utt_id", (F.col("n_repetition") + F.col("n_repair") + F.col("n_false_start")).alias("structural"))


def inject_rules_inverse(spark, sf_dir):
    """The rule injector's speech without what it put in, for each script."""
    from disfluo.operators import evaluate
    from disfluo.plans.evaluation import RULES

    out = inject.spoken_by_rules(corpus.scripts(spark, sf_dir), RULES)
    kept = F.filter(F.transform("alignment", lambda i, j: F.struct(i.alias("i"), F.get("disfluent_tokens", j).alias("w"))), lambda x: x.i.isNotNull())
    return out.select("utt_id", evaluate.without_disfluencies().alias("clean"), F.array_join(F.transform(F.array_sort(kept), lambda x: x.w), " ").alias("spoken"))


QUERIES = {f.__name__: f for f in (
    jsonl_roundtrip, transcript_statuses, transcript_layouts, generations_of_systems, level_settings, frequencies_roundtrip, generations_roundtrip, report_roundtrip, training_pairs, real_pairs, typed_lines, sentence_source, template_sentences, source_pools,
    balanced_generation, training_mix, repairs_per_split, annotation_types, word_spans, folded_scores, surprisal_bits, annotations_json, structural_events, inject_rules_inverse)}


def _u(*parts: str) -> str:
    return f"(CAST(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8)) AS BIGINT) / 4294967296.0)"


def _template_sql(each: int = 20, seed: str = "13") -> str:
    text = "text"
    for name, values in VALUES.items():
        n, options = len(values), "[" + ", ".join(f"'{v}'" for v in values) + "]"
        at = lambda slot, m: f"CAST(floor({_u(f'''{seed!r}''', repr('slot'), 'template_id', 'draw', repr(slot))} * {m}) AS INTEGER)"  # noqa: B023, E731
        other = f"(({at(name, n)} + 1 + {at(name + '2', max(1, n - 1))}) % {n})"
        text = f"replace(replace({text}, '{{{name}2}}', {options}[{other} + 1]), '{{{name}}}', {options}[{at(name, n)} + 1])"
    rows = ", ".join(f"({k}, '{t}')" for k, t in enumerate(TEMPLATES))
    return f"""tp AS (SELECT template_id, draw, {text} AS text FROM (VALUES {rows}) t(template_id, text), range({3 * each}) r(draw)),
tf AS (SELECT template_id, text, min(draw) AS draw FROM tp GROUP BY ALL), ts AS (SELECT template_id, text FROM (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY draw) AS n FROM tf) WHERE n <= {each})"""


def _cut(source: str, name: str, columns: str) -> str:
    return f"""{name} AS (SELECT *, CASE WHEN n < floor(total * CAST(0.8 AS DOUBLE)) THEN 'train' WHEN n < floor(total * CAST(0.8 AS DOUBLE)) + floor(total * CAST(0.04 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split
FROM (SELECT {columns}, row_number() OVER (ORDER BY {_H("13", "text")}, {columns}) - 1 AS n, count(*) OVER () AS total FROM {source}))"""


_SENTENCES = rf"""sl0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line_text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE text IS NOT NULL),
sl1 AS (SELECT doc_id, line, string_split(regexp_replace(line_text, '([.!?])\s+([A-Z"“])', '\1' || chr(10) || '\2', 'g'), chr(10)) AS s FROM sl0 WHERE NOT starts_with(ltrim(line_text), '=')),
sl2 AS (SELECT doc_id, line, trim(unnest(s)) AS raw, generate_subscripts(s, 1) AS pos FROM sl1),
sl3 AS (SELECT *, {_DETOK.format("raw")} AS sent FROM sl2 WHERE raw <> ''), sl4 AS (SELECT *, {SPLIT("sent")} AS ws FROM sl3),
ok AS (SELECT sent AS text, min({{'a': doc_id, 'b': line, 'c': pos}}) AS at_ FROM sl4 WHERE {_BAD} AND regexp_matches(sent, '^[A-Z]') AND regexp_matches(sent, '[.!?]$') AND len(ws) BETWEEN 5 AND 40 AND regexp_matches(sent, '^[A-Za-z0-9 ,.;:!?''()%&$£€-]+$')
  AND NOT regexp_matches(sent, '(^|[^A-Za-z])''|''([^A-Za-z]|$)') AND {_ABBR} AND len(list_filter(ws, lambda w: regexp_matches(w, '^[0-9]'))) <= len(ws) // 3 AND len(list_filter(ws, lambda w: NOT regexp_matches(w, '[0-9a-zA-Z]'))) = 0 GROUP BY sent),
fa AS (SELECT *, len(list_filter(string_split(text, ' '), lambda w: lower(trim(w, '.,;:!?"''()')) IN ({_AMB}))) > 0 AS ambiguous FROM ok)"""
_ASKED = f"sx AS (SELECT utt_id * 4 + k AS utt_id, doc_id, clean, clean_tokens, n_clean, CAST(k AS INTEGER) AS asked_level FROM scripts, range(4) r(k) WHERE n_clean >= {L.MIN_WORDS})"


def _balanced_sql(each: int = 60) -> str:
    """Levels in the order of their sizes; each takes its first rows of sentences that no level before it has taken."""
    steps = [f"""bl AS (SELECT utt_id, utt_id // 4 AS sentence, asked_level, {LEVEL_SQL} AS level, {_H("13", "utt_id")} AS h FROM ms_x, cuts),
sz AS (SELECT level, row_number() OVER (ORDER BY count(*), level) AS turn FROM bl GROUP BY level), t0 AS (SELECT utt_id, sentence, asked_level, level FROM bl WHERE false)"""]
    for k in range(1, 5):
        steps.append(f"""c{k} AS (SELECT sentence, min({{'h': h, 'u': utt_id}}) AS least FROM bl JOIN sz USING (level) WHERE turn = {k} AND sentence NOT IN (SELECT sentence FROM t{k - 1}) GROUP BY sentence ORDER BY least LIMIT {each}),
t{k} AS (SELECT * FROM t{k - 1} UNION ALL SELECT bl.utt_id, bl.sentence, asked_level, bl.level FROM bl JOIN c{k} ON bl.utt_id = c{k}.least.u)""")
    return ", ".join(steps)


_INVERSE = "array_to_string(clean_tokens, ' ')"
_SPOKEN_COUNT = "SELECT asked_level AS level, count(*) AS n, CAST(sum(length(array_to_string(disfluent_tokens, ' '))) AS BIGINT) AS characters FROM"
ORACLES = {
    "generations_of_systems": f"{W},{corpus.spoken_sql('_r', seed='run')} SELECT 'first' AS system, * FROM ({_SPOKEN_COUNT} utt GROUP BY ALL) UNION ALL SELECT 'second', * FROM ({_SPOKEN_COUNT} utt_r GROUP BY ALL)",
    "transcript_layouts": f"""{W}, mk AS (SELECT utt_id, CAST(sum(length(piece)) + max(i) + 2 AS BIGINT) AS size FROM (SELECT utt_id, i, CASE coalesce(kind, '') WHEN '' THEN word WHEN 'filler' THEN '{{F ' || array_to_string(head, ' ') || ', }} ' || word WHEN 'false_start' THEN '[ ' || array_to_string(head, ' ') || ', + ] ' || word
  WHEN 'repetition' THEN '[ ' || array_to_string(head, ' ') || ', + ' || word || ' ]' ELSE '[ ' || head[1] || ', + ' || CASE WHEN len(head) > 1 THEN '{{E ' || array_to_string(head[2 : len(head)], ' ') || ', }} ' ELSE '' END || word || ' ]' END AS piece FROM ev) GROUP BY utt_id)
SELECT CAST(utt_id % 3 AS INTEGER) AS layout, CAST(utt_id % 7 AS VARCHAR) AS conversation_no, count(*) AS n, CAST(sum(size) AS BIGINT) AS characters, count(*) FILTER (utt_id % 3 = 1) AS with_line_end FROM mk WHERE utt_id % 3 < 2 GROUP BY ALL""",
    "jsonl_roundtrip": f"{W}, g AS (SELECT asked_level, {SUMS_SQL} FROM ms GROUP BY asked_level) {rates_sql('g', 'asked_level,')}",
    "transcript_statuses": f"""{W}, t AS (SELECT utt_id % 5 AS r, array_to_string(disfluent_tokens, ' ') AS spoken FROM utt)
SELECT 'unparsed' AS status, count(*) AS n FROM t WHERE r = 1 UNION ALL SELECT 'length', count(*) FROM t WHERE r = 2
UNION ALL SELECT 'kept', count(DISTINCT CASE WHEN r = 3 THEN 'it is said again and again' ELSE spoken END) FROM t WHERE r IN (0, 3, 4)
UNION ALL SELECT 'duplicate', count(*) - count(DISTINCT CASE WHEN r = 3 THEN 'it is said again and again' ELSE spoken END) FROM t WHERE r IN (0, 3, 4)""",
    "level_settings": f"""{W}, {CUTS_SQL}, lv AS (SELECT *, {LEVEL_SQL} AS level FROM ms, cuts WHERE n_clean >= {L.MIN_WORDS}),
g AS (SELECT level, {SUMS_SQL} FROM lv GROUP BY level), f AS (SELECT CAST(r.level AS INTEGER) AS level, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ["utterances", "clean_words", "events", "inserted", *[f"n_{t}" for t in L.TYPES]])} FROM range(4) r(level) LEFT JOIN g USING (level)),
p AS ({rates_sql("f", "level,")}) SELECT level, {", ".join(f"rate_{t} AS {t}" for t in L.TYPES)}, total_rate AS total, {", ".join(f"mix_{t}" for t in L.TYPES)} FROM p""",
    "frequencies_roundtrip": f"{W}, {UNI_SQL} SELECT word, log_freq FROM uni",
    "generations_roundtrip": f"{W} SELECT 'injector' AS system, asked_level AS level, count(*) AS n, CAST(sum(length(array_to_string(disfluent_tokens, ' '))) AS BIGINT) AS characters FROM utt GROUP BY asked_level",
    "report_roundtrip": f"{W} SELECT 'rates' AS name, asked_level, CAST(sum(n_events) AS BIGINT) AS events FROM ms GROUP BY asked_level UNION ALL SELECT 'totals', -1, CAST(sum(n_events) AS BIGINT) FROM ms",
    "training_pairs": f"{W} SELECT '<d' || asked_level || '> say aloud: ' || clean AS source, array_to_string(disfluent_tokens, ' ') AS target, asked_level AS level FROM utt",
    "real_pairs": f"{W} SELECT utt_id, n_clean, CASE WHEN n_events = 0 THEN 0 WHEN rate >= CAST(21.42857142857143 AS DOUBLE) THEN 3 WHEN rate >= 10.0 THEN 2 ELSE 1 END AS level FROM ms WHERE n_clean >= {L.MIN_WORDS}",
    "typed_lines": "SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS line, clean FROM (SELECT conv_id, turn, i, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS clean FROM (SELECT conv_id, turn, unnest(l) AS raw, generate_subscripts(l, 1) AS i FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations WHERE text IS NOT NULL))) WHERE clean <> ''",
    "sentence_source": f"""WITH {_SENTENCES}, r AS (SELECT *, row_number() OVER (PARTITION BY ambiguous ORDER BY at_) AS n FROM fa)
SELECT text, ambiguous, CAST(row_number() OVER (ORDER BY ambiguous, at_) AS INTEGER) AS place FROM r WHERE n <= CASE WHEN ambiguous THEN 90 ELSE 210 END""",
    "template_sentences": f"""{W}, {UNI_SQL}, {_template_sql()}, tw AS (SELECT template_id, text, unnest(list_distinct(list_transform(list_filter(string_split(text, ' '), lambda w: w <> ''), lambda w: {UNI_KEY}))) AS word FROM ts)
SELECT template_id, text, count(*) AS words, count(uni.word) AS known FROM tw LEFT JOIN uni ON tw.word = uni.word GROUP BY ALL""",
    "source_pools": f"""{W}, {_template_sql()}, hd AS (SELECT template_id FROM (SELECT DISTINCT template_id FROM ts) ORDER BY {_H("13", "template_id")}, template_id LIMIT {round(0.2 * len(TEMPLATES))}),
cs AS (SELECT DISTINCT clean AS text FROM scripts), sn_ AS (SELECT * FROM ts WHERE template_id NOT IN (SELECT template_id FROM hd)), {_cut("cs", "cc", "text")}, {_cut("sn_", "tc", "template_id, text")}
SELECT text, 'corpus' AS source, CAST(NULL AS INTEGER) AS template_id, split FROM cc UNION ALL SELECT text, 'template', template_id, split FROM tc UNION ALL SELECT text, 'template', template_id, 'test' FROM ts WHERE template_id IN (SELECT template_id FROM hd)""",
    "balanced_generation": f"{W}, {CUTS_SQL}, {_ASKED}, {corpus.spoken_sql('_x', source='sx', seed='draw')}, {_balanced_sql()} SELECT utt_id, sentence, asked_level, level FROM t4",
    "training_mix": f"""{W}, m AS (SELECT utt_id, asked_level AS level, CASE WHEN asked_level < 3 THEN 'synthetic' ELSE 'real' END AS source, {_H("13:mix", "utt_id")} AS h, row_number() OVER (PARTITION BY asked_level = 3 ORDER BY {_H("13", "utt_id")}, utt_id) AS n FROM scripts)
SELECT CAST(real AS INTEGER) AS real, source, level, count(*) AS pairs, min(CASE WHEN real <> 0 THEN h END) AS first FROM m, (VALUES (0), (400), (-1)) v(real) WHERE source = 'synthetic' OR real < 0 OR n <= real GROUP BY ALL""",
    "repairs_per_split": f"""{W}, c AS (SELECT doc_id AS conv_id, count(*) AS n, sum(n_repair) AS repairs, {_H("13", "doc_id")} AS h FROM ms GROUP BY doc_id), t AS (SELECT sum(n) AS total FROM c),
a AS (SELECT *, coalesce(sum(n) OVER (ORDER BY h, conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < floor(total * CAST(0.25 AS DOUBLE)) AS held FROM c, t),
b AS (SELECT *, coalesce(sum(CASE WHEN held THEN 0 ELSE n END) OVER (ORDER BY h, conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a)
SELECT CASE WHEN held THEN 'eval' WHEN before < floor(total * CAST(0.05 AS DOUBLE)) THEN 'val' ELSE 'train' END AS split, CAST(sum(n) AS BIGINT) AS utterances, count(*) AS conversations, CAST(sum(repairs) AS BIGINT) AS repairs FROM b GROUP BY 1""",
    "annotation_types": f"{W} SELECT type, count(*) AS n FROM ann GROUP BY type",
    "word_spans": f"""{W}, x AS (SELECT utt_id, unnest(string_split(clean, ' ')) AS w, generate_subscripts(string_split(clean, ' '), 1) AS i FROM scripts),
y AS (SELECT *, coalesce(sum(length(w) + 1) OVER (PARTITION BY utt_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM x)
SELECT utt_id, CAST(row_number() OVER (PARTITION BY utt_id ORDER BY i) - 1 AS INTEGER) AS word, CAST(s AS INTEGER) AS start, CAST(s + length(w) AS INTEGER) AS "end" FROM y WHERE w <> ''""",
    "folded_scores": f"""{W}, x AS (SELECT utt_id, unnest(string_split(clean, ' ')) AS w, generate_subscripts(string_split(clean, ' '), 1) AS i FROM scripts),
y AS (SELECT *, coalesce(sum(length(w) + 1) OVER (PARTITION BY utt_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM x),
z AS (SELECT utt_id, CAST(row_number() OVER (PARTITION BY utt_id ORDER BY i) - 1 AS INTEGER) AS word, s, lead(s) OVER (PARTITION BY utt_id ORDER BY i) AS past FROM y WHERE w <> ''),
p AS (SELECT utt_id, k, substr(clean, 3 * k + 1, 3) AS t FROM (SELECT utt_id, clean, unnest(range(CAST(ceil(length(clean) / 3.0) AS BIGINT))) AS k FROM scripts)),
q AS (SELECT utt_id, 3 * k + length(t) - length(ltrim(t)) AS at_, CAST(k % 7 AS DOUBLE) AS bits FROM p WHERE trim(t) <> '')
SELECT z.utt_id, z.word, coalesce(sum(q.bits), 0.0) AS bits FROM z LEFT JOIN q ON q.utt_id = z.utt_id AND q.at_ >= z.s AND (z.past IS NULL OR q.at_ < z.past) GROUP BY ALL""",
    "surprisal_bits": f"{W} SELECT utt_id, round(-log2(exp(n_clean / CAST(10 AS DOUBLE)) / (exp(n_clean / CAST(10 AS DOUBLE)) + 1 + exp(-CAST(n_clean AS DOUBLE)) + exp(CAST(1.5 AS DOUBLE)))), 9) AS bits FROM scripts",
    "annotations_json": f"{W} SELECT utt_id, CAST(count(type) AS INTEGER) AS n, CAST(count(int_s) AS INTEGER) AS with_interregnum FROM scripts LEFT JOIN ann USING (utt_id) GROUP BY utt_id",
    "structural_events": f"{W} SELECT utt_id, n_repetition + n_repair + n_false_start AS structural FROM ms",
    "inject_rules_inverse": f"{W}, o AS (SELECT utt_id, list_transform(clean_tokens, lambda w: {SPOKEN("w")}) AS s, {_INVERSE} AS clean FROM scripts) SELECT utt_id, clean, array_to_string(s, ' ') AS spoken FROM o",
}
