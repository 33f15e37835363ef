"""Readers and writers: transcripts, utterances, pairs, level specifications, frequencies and generations.

All paths go to Spark's own readers, so any store that Spark reads will do. A missing path gives an empty table where the
caller may run without it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from disfluo import schemas
from disfluo.functions import lexicon as L
from disfluo.functions.report import markdown
from disfluo.functions.text import as_sentence, control_source, is_ambiguous, is_usable, may_be_usable, sentence_split
from disfluo.operators import measure, parse
from disfluo.operators.corpus import spread
from disfluo.operators.levels import TOKENS
from disfluo.operators.ordering import seeded


FILES_BROADCAST = 100_000  # so many files' headers are broadcast at most


def _with_whole_records(lines: DataFrame) -> DataFrame:
    """Lines (file, ord, value) as records: a line whose quotes so far in its file are odd goes on with the record before it.

    Running counts are taken within a file's blocks and over the blocks' totals, so a large file is many tasks' work.
    """
    odd = F.pmod(F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit(""))), F.lit(2))
    lines = lines.select("file", "ord", F.col("ord.block").alias("block"), "value", odd.alias("odd"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("file", "block").orderBy("ord")
    blocks = lines.groupBy("file", "block").agg(F.sum("odd").alias("n")).withColumn("open", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    lines = lines.join(blocks, ["file", "block"]).withColumn("open", F.col("open") + F.coalesce(F.sum("odd").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    lines = lines.withColumn("begins", F.when(F.pmod("open", F.lit(2)) == 0, F.col("ord")))
    held = lines.groupBy("file", "block").agg(F.max("begins").alias("last")).withColumn("before", F.last("last", ignorenulls=True).over(earlier)).drop("last")
    lines = lines.join(held, ["file", "block"]).withColumn("first", F.coalesce(F.last("begins", ignorenulls=True).over(within), "before"))
    parts = F.array_sort(F.collect_list(F.struct("ord", "value")))
    return lines.groupBy("file", "first").agg(F.array_join(F.transform(parts, lambda x: x.value), "\n").alias("value")).select("file", F.col("first").alias("ord"), "value")


def read_transcripts(spark: SparkSession, root: str) -> DataFrame:
    """text, conversation_no, file and ord (order within a file) of every CSV file under root.

    Each file's own header says where its columns are; a file without a ``text`` column is passed over, one without
    ``conversation_no`` has nulls there. Undecodable bytes become replacement characters, blank lines are no rows, and cells may
    hold line ends. Files are read by lines, so a large one is split; only files with such cells have their lines put together.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(root)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = raw.select(F.col("_metadata.file_path").alias("file"), at.alias("ord"), F.make_valid_utf8("value").alias("value"))
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    heads = lines.groupBy("file").agg(F.min_by("value", "ord").alias("head"), F.min("ord").alias("top"), F.max(F.pmod(quotes, F.lit(2))).alias("spans"))
    stat = heads.agg(F.max(F.size(F.split("head", ","))).alias("width"), F.count("*").alias("files"), F.max("spans").alias("spans")).first()
    names = [f"c{k}" for k in range(stat["width"] or 1)]
    cells = lambda c: F.from_csv(F.col(c), ", ".join(f"{n} string" for n in names), {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1"})
    heads = heads.withColumn("h", cells("head")).withColumn("h", F.array(*[F.col(f"h.{n}") for n in names]))
    heads = heads.select("file", "top", "spans", *[F.array_position("h", n).cast("int").alias(f"at_{n}") for n in schemas.TRANSCRIPT.names]).filter("at_text > 0")
    known = F.broadcast(heads) if stat["files"] <= FILES_BROADCAST else heads
    body = lines.join(known, "file").filter(F.col("ord") > F.col("top"))
    rows = body.select("file", "ord", "value")
    if stat["spans"]:
        rows = body.filter("spans = 0").select("file", "ord", "value").unionByName(_with_whole_records(body.filter("spans = 1").select("file", "ord", "value")))
    rows = rows.filter(F.col("value") != "").join(known, "file").withColumn("c", cells("value")).withColumn("c", F.array(*[F.col(f"c.{n}") for n in names]))
    return rows.select(*[F.get("c", F.col(f"at_{n}") - 1).alias(n) for n in schemas.TRANSCRIPT.names], "file", "ord").filter("text is not null")


def load_utterances(spark: SparkSession, root: str, least: int = 5, most: int = 40) -> DataFrame:
    """Parsed utterances with their status; the first of equal spoken texts, in order of file and line, is kept, the rest are duplicates."""
    rows = parse.utterances(read_transcripts(spark, root), least=least, most=most)
    rows = rows.withColumn("disfluent", F.array_join("disfluent_tokens", " ")).withColumn("clean", F.array_join("clean_tokens", " ")).withColumn("_at", F.struct("file", "ord"))
    firsts = rows.filter("status = 'kept'").groupBy("disfluent").agg(F.min("_at").alias("_first"))
    out = rows.join(firsts, "disfluent", "left")
    status = F.when((F.col("status") == "kept") & (F.col("_at") != F.col("_first")), "duplicate").otherwise(F.col("status"))
    return out.withColumn("status", status).withColumn("source", F.lit("transcript")).drop("_first", "_at")


def parse_counts(utterances: DataFrame) -> DataFrame:
    """How many units there are of each status."""
    return utterances.groupBy("status").agg(F.count("*").alias("n"))


def _or_empty(spark: SparkSession, read, schema) -> DataFrame:
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_jsonl(spark: SparkSession, path: str, schema=schemas.UTTERANCE) -> DataFrame:
    """One JSON object on each line; blank lines are skipped, unknown fields ignored, missing ones null."""
    return spark.read.schema(schema).json(path).filter(F.greatest(*[F.col(f"`{c}`").isNotNull() for c in schema.names]))


def load_pairs(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """Source, target and level of training pairs: the three fields that training needs and no others; empty if there is no file."""
    rows = _or_empty(spark, lambda: spark.read.schema(schemas.UTTERANCE).json(path).select("clean", "disfluent", "level"), "clean string, disfluent string, level int")
    rows = rows.filter("clean is not null and disfluent is not null")
    return rows.limit(limit) if limit > 0 else rows


def real_pairs(spark: SparkSession, path: str, light: float, heavy: float, limit: int = 0) -> DataFrame:
    """Annotated pairs of at least ten clean words, labelled by their own rate at the given cuts."""
    rows = _or_empty(spark, lambda: spark.read.schema(schemas.UTTERANCE).json(path), schemas.UTTERANCE)
    words = F.coalesce(F.size("clean_tokens"), F.size(F.split("clean", r"\s+")))
    rows = rows.withColumn("n_clean", words).filter(F.col("n_clean") >= L.MIN_WORDS)
    events = F.size(F.filter("annotations", lambda a: a.type.isin(*L.TYPES)))
    rate = events * (F.lit(100.0) / F.col("n_clean"))
    level = F.when(events == 0, 0).when(rate >= heavy, 3).when(rate >= light, 2).otherwise(1)
    rows = rows.withColumn("level", level).withColumn("asked_level", level)
    return rows.limit(limit) if limit > 0 else rows


def read_levels(spark: SparkSession, path: str) -> dict:
    """A level specification: one small JSON document, which may hold a bare Infinity."""
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def write_levels(table: DataFrame, cuts: DataFrame, path: str) -> None:
    """The level table (four rows) and the two cuts as one JSON document."""
    levels = [json.loads(x) for x in table.orderBy("level").toJSON().collect()]
    spark = table.sparkSession
    spark.createDataFrame([(json.dumps({"cuts": cuts.first().asDict(), "levels": levels}),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_frequencies(words: DataFrame, path: str) -> None:
    words.select("word", "log_freq").write.mode("overwrite").json(path)


def read_frequencies(spark: SparkSession, path: str, required: bool = False) -> DataFrame:
    """word and log_freq; empty if there is no file, unless it is required."""
    schema = "word string, log_freq double"
    read = lambda: spark.read.schema(schema).json(path)
    return read() if required else _or_empty(spark, read, schema)


def read_lines(spark: SparkSession, lines: list[str]) -> DataFrame:
    """utt_id and clean of the lines that aren't blank."""
    return spark.createDataFrame([(k, x.strip()) for k, x in enumerate(lines) if x.strip()], "utt_id long, clean string")


def lines_of(rows: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """keys, line and clean of the lines of a text column that aren't blank, stripped and numbered within their text; a null text has none."""
    lines = rows.select(*keys, F.posexplode(F.split(text, "\n")).alias("line", "raw"))
    return lines.select(*keys, "line", F.btrim("raw", F.lit(" \t\r\x0b\x0c")).alias("clean")).filter("clean <> ''")


def write_generations(rows: DataFrame, path: str) -> None:
    """Generations laid out by system and level, so that readers prune to what they need. What stands there of the same systems and
    levels is replaced, so writing again changes nothing; all else stays."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("system", "level").parquet(path)


def read_generations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_generation_dumps(spark: SparkSession, glob: str) -> DataFrame:
    """JSON-lines dumps named <system>_d<level>.jsonl; both come from the file name, cut at its last ``_d``."""
    rows = spark.read.schema(schemas.UTTERANCE).json(glob)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.jsonl$", 1)
    return rows.withColumn("system", F.regexp_extract(name, r"^(.*)_d[0-9]+$", 1)).withColumn("level", F.regexp_extract(name, r"_d([0-9]+)$", 1).cast("int"))


def write_jsonl(rows: DataFrame, path: str) -> int:
    """Write rows as JSON lines and return how many there were, counted while writing."""
    from pyspark.sql import Observation

    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def _first_of_each_task(good: DataFrame, order: str, most: int) -> DataFrame:
    """good without what can't be among the first ``most`` distinct plain or ambiguous sentences: each task keeps so many of each.

    A sentence that is among the first of all is among the first of the task where it first stands, so nothing is lost, and no
    more than tasks x 2 x most rows are shuffled. What comes after the last of a full kind is passed over before it is sorted.
    """
    place = [(c, "ascending") for c in (order, "line", "pos")]

    def first(rows: pa.Table) -> list[pa.Table]:
        rows = rows.take(pc.sort_indices(rows, sort_keys=place, null_placement="at_start"))
        at = rows.append_column("_n", pa.array(range(len(rows)), pa.int64())).group_by("text").aggregate([("_n", "min")])["_n_min"]
        rows = rows.take(at.take(pc.sort_indices(at)))
        return [rows.filter(pc.equal(rows["ambiguous"], flag)).slice(0, most) for flag in (False, True)]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            for kind, flag in zip(held or [], (False, True)):
                if len(kind) == most and kind[order][-1].is_valid:
                    late = pc.and_(pc.equal(rows["ambiguous"], flag), pc.fill_null(pc.greater(rows[order], kind[order][-1]), False))
                    rows = rows.filter(pc.invert(late))
            if len(rows):
                held = first(pa.concat_tables([*(held or []), rows]))
        for kind in held or []:
            yield from kind.combine_chunks().to_batches()

    return good.mapInArrow(keep, good.schema)


def _sentences(rows: DataFrame, order: str) -> DataFrame:
    """text, ambiguous and place (order, line, pos) of the usable sentences of rows (text, order); headings are passed over."""
    lines = rows.select(order, F.posexplode(F.split("text", "\n")).alias("line", "raw")).filter(~F.ltrim("raw").startswith("="))
    sents = lines.select(order, "line", F.posexplode(sentence_split(F.col("raw"))).alias("pos", "raw")).filter(may_be_usable(F.col("raw")))
    good = sents.select(order, "line", "pos", F.explode(F.array(as_sentence(F.col("raw")))).alias("text")).filter(is_usable(F.col("text")))  # one element, so it is worked out once
    return good.withColumn("ambiguous", is_ambiguous(F.col("text")))


def usable_sentences(rows: DataFrame, order: str, most: int | None = None) -> DataFrame:
    """text, ambiguous and the first place (order, line, pos) of each distinct usable sentence of rows (text, order), or of those that can
    be among the first ``most`` of their kind; headings are passed over."""
    good = _sentences(rows, order)
    good = good if most is None else _first_of_each_task(good, order, most)
    # ambiguous is aggregated, so that a filter on it stays above: plain and ambiguous ones come from the same rows, read once
    return good.groupBy("text").agg(F.min(F.struct(order, "line", "pos")).alias("at"), F.bool_or("ambiguous").alias("ambiguous"))


def _quota(limit: int, ambiguous_share: float) -> dict[bool, int]:
    """How many sentences are wanted at most, plain (False) and ambiguous (True)."""
    want = int(max(0, limit) * ambiguous_share)
    return {False: max(0, limit) - want, True: want}


def with_quota(sentences: DataFrame, limit: int, ambiguous_share: float = 0.30) -> DataFrame:
    """text and place of at most ``limit`` sentences: the first plain ones, then the first ambiguous ones, of which a share is kept free."""
    plain, ambiguous = (sentences.filter(F.col("ambiguous") == flag).orderBy("at").limit(n) for flag, n in _quota(limit, ambiguous_share).items())
    both = plain.unionByName(ambiguous)
    return both.withColumn("place", F.row_number().over(Window.orderBy("ambiguous", "at"))).select("text", "ambiguous", "place")  # at most limit rows


def sentence_source(spark: SparkSession, paths: list[str], limit: int, ambiguous_share: float = 0.30, order: str = "doc_id") -> DataFrame:
    """Sentences of the first of several tables, the largest first, that can be read and has any; none if there is no such table.

    A table before the last is asked for one sentence of a kind that is wanted, which ends at the first; the last is taken as it is.
    """
    empty = spark.createDataFrame([], "text string, ambiguous boolean, place int")
    if limit <= 0:
        return empty
    wanted = [flag for flag, n in _quota(limit, ambiguous_share).items() if n > 0]
    for k, path in enumerate(paths, 1):
        rows = _or_empty(spark, lambda p=path: spark.read.parquet(p), f"{order} long, text string")
        rows = rows.filter("text is not null").select(order, "text")
        if k == len(paths) or not _sentences(rows, order).filter(F.col("ambiguous").isin(wanted)).isEmpty():
            return with_quota(usable_sentences(spread(rows), order, limit), limit, ambiguous_share)
    return empty


def mix_real(synthetic: DataFrame, real: DataFrame, limit: int, seed: str = "13", key: str = "utt_id") -> DataFrame:
    """Synthetic pairs with real ones folded in, tagged by source: none of them at 0, all below 0, else so many in a seeded order.
    ``h`` is the order that shuffles the mix; a mix without real pairs stays as it was."""
    own = synthetic.withColumn("source", F.lit("synthetic"))
    if limit == 0:
        return own.withColumn("h", F.lit(None).cast("string"))
    taken = real if limit < 0 else real.orderBy(seeded(seed, key), key).limit(limit)
    return own.unionByName(taken.withColumn("source", F.lit("real")), allowMissingColumns=True).withColumn("h", seeded(seed + ":mix", key))


def training_rows(pairs: DataFrame) -> DataFrame:
    """What a sequence model is trained on: the script behind its level's control token, the spoken side, and the level."""
    return pairs.filter("clean is not null and disfluent is not null and level is not null").select(control_source(F.col("level"), F.col("clean")).alias("source"), F.col("disfluent").alias("target"), "level")


def tokenised(rows: DataFrame, tokenizer: str, max_source: int = 128, max_target: int = 160) -> DataFrame:
    """Token ids of source and target, cut to their lengths, by a tokenizer file; the control tokens are single tokens of their own."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(tokenizer)
        own.add_special_tokens(list(TOKENS))
        for batch in batches:
            ids = lambda texts, most: [x.ids[:most] for x in own.encode_batch(texts.tolist(), add_special_tokens=False)]
            yield pd.DataFrame({"input_ids": ids(batch["source"], max_source), "labels": ids(batch["target"], max_target), "level": batch["level"]})

    return rows.select("source", "target", "level").mapInPandas(encode, "input_ids array<int>, labels array<int>, level int")


def _text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _rows(table: DataFrame, most: int) -> list[dict]:
    rows = [json.loads(x) for x in table.limit(most + 1).toJSON().collect()]
    if len(rows) > most:
        raise ValueError(f"a report holds tables of at most {most} rows")
    return rows


def write_report(tables: dict[str, DataFrame], path: str, most: int = 10_000) -> None:
    """Small tables as one JSON document, and as Markdown beside it (path + ".md"). Write it before a step that may fail, and patch it after."""
    spark = next(iter(tables.values())).sparkSession
    _text(spark, json.dumps({name: _rows(t, most) for name, t in tables.items()}), path)
    _text(spark, "\n\n".join(f"## {name}\n\n{markdown(t, t.columns[:1] if 'place' not in t.columns else ['place'])}" for name, t in tables.items()), path + ".md")


def read_report(spark: SparkSession, path: str) -> dict[str, list[dict]]:
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def patch_report(table: DataFrame, name: str, path: str, most: int = 10_000) -> None:
    """Put one more table into a report that has been written."""
    spark = table.sparkSession
    _text(spark, json.dumps(read_report(spark, path) | {name: _rows(table, most)}), path)


def labelled(utterances: DataFrame) -> DataFrame:
    """Utterances with their measured level at their own corpus's cuts."""
    m = measure.measure(utterances.withColumn("n_clean", F.size("clean_tokens")).withColumn("doc_id", F.col("utt_id")))
    return measure.with_level(measure.eligible(m), measure.percentile_cuts(m))
