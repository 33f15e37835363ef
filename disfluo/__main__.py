"""Command lines of the engine.

python -m disfluo [--level N | --all-levels] [--trace] [--seed N] [--spec FILE] [--dump DIR] TEXT...   speak lines
python -m disfluo COMMAND ...   corpus | rates | detect | pairs | evaluate | roundtrip | copyfail | surprisal | levels

Every path goes to Spark's readers and writers. Corpora, pairs and generations are JSON lines in the engine's layout.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from disfluo.functions.report import markdown, qualitative
from disfluo.functions.text import canonical_tokens, spoken_form, spoken_text, tokens
from disfluo.operators import detect, evaluate, levels, measure, ordering, pools, report, systems
from disfluo.plans.evaluation import RULES
from disfluo.sources import io


def numbered(rows: DataFrame) -> DataFrame:
    """Rows of a corpus file with what measuring needs; rows without a number get one."""
    if "utt_id" not in rows.columns or rows.filter("utt_id is null").limit(1).count():
        rows = rows.withColumn("utt_id", F.xxhash64("clean", "disfluent", "conversation"))
    return rows.withColumn("n_clean", F.size("clean_tokens")).withColumn("doc_id", F.lit(0).cast("long")).withColumn("asked_level", F.coalesce("asked_level", "level"))


def dial(spark: SparkSession, path: str | None) -> dict:
    return levels.dial(io.read_levels(spark, path)) if path else RULES


def speak(spark: SparkSession, a: argparse.Namespace) -> int:
    lines = [" ".join(a.text)] if a.text else sys.stdin.read().splitlines()
    scripts = io.read_lines(spark, lines)
    if scripts.isEmpty():
        print("nothing to say", file=sys.stderr)
        return 1
    asked = scripts.withColumn("asked_level", F.explode(F.array(*map(F.lit, levels.LEVELS if a.all_levels else [levels.check(a.level)]))))
    said = systems.resolve(a.system, dial(spark, a.spec), a.seed, a.model).speak(asked)
    if a.dump:
        io.write_generations(said.withColumn("system", F.lit("injector")).withColumn("level", F.col("asked_level")), a.dump)
    for r in said.orderBy("utt_id", "asked_level").select("asked_level", "spoken").collect():  # as many lines as were typed
        print(f"<d{r['asked_level']}> {r['spoken']}" if a.all_levels else r["spoken"])
    if a.trace:
        rows = detect.trace(detect.detected(said.select((F.col("utt_id") * 4 + F.col("asked_level")).alias("utt_id"), "clean", "spoken")))
        print(markdown(rows, ["utt_id", "position"]))
    return 0


def corpus(spark: SparkSession, a: argparse.Namespace) -> int:
    """Transcripts to utterances, and to conversation-disjoint splits."""
    if a.root:
        rows = io.load_utterances(spark, a.root)
        print(markdown(io.parse_counts(rows), ["status"]))
        rows = rows.filter("status = 'kept'").select("disfluent", "clean", "disfluent_tokens", "clean_tokens", "alignment", "annotations", "source", F.col("conversation_no").alias("conversation"))
    else:
        rows = io.read_jsonl(spark, a.from_jsonl)
    rows = rows.limit(a.limit) if a.limit else rows
    if a.root:
        print(f"wrote {io.write_jsonl(rows, a.out)} utterances to {a.out}")
    if a.split:
        sizes = rows.groupBy(F.coalesce("conversation", F.lit("")).alias("conv_id")).agg(F.count("*").alias("n"))
        split = ordering.split_by_conversation(sizes, str(a.seed), a.eval_fraction, a.val_fraction).select("conv_id", "split")
        tagged = rows.join(split, F.coalesce("conversation", F.lit("")) == F.col("conv_id")).drop("conv_id")
        for name in ("train", "val", "eval"):
            n = io.write_jsonl(tagged.filter(F.col("split") == name).drop("split"), f"{a.out}.{name}")
            print(f"  {name}: {n} utterances")
    return 0


def rates(spark: SparkSession, a: argparse.Namespace) -> int:
    """The dial: level table, cuts, shape and word frequencies of a corpus."""
    rows = numbered(io.read_jsonl(spark, a.data))
    m = measure.measure(rows)
    table, cuts = measure.level_table(m), measure.percentile_cuts(m)
    io.write_levels(table, cuts, a.out)
    io.write_frequencies(measure.unigrams(rows), a.frequencies)
    for t, key in ((table, ["level"]), (cuts, ["light"]), (measure.shape_parameters(rows), ["repairs"])):
        print(markdown(t, key) + "\n")
    return 0


def check(spark: SparkSession, a: argparse.Namespace) -> int:
    """The detector against the corpus's own annotations."""
    rows = numbered(io.read_jsonl(spark, a.data))
    rows = rows.limit(a.limit) if a.limit else rows
    found = detect.detected(rows.select("utt_id", "clean", F.col("disfluent").alias("spoken")))
    cells = report.by_count(detect.confusion(rows, found))
    io.write_report({"check": detect.check(cells), "confusion": cells}, a.out)
    print(markdown(detect.check(cells), ["gold"]) + "\n\n" + markdown(cells, ["place"]))
    return 0


def pairs(spark: SparkSession, a: argparse.Namespace) -> int:
    """Balanced synthetic pairs from templates and sentences: spoken at every level, relabelled, drawn level by level."""
    sizes = {"train": a.train, "val": a.val, "test": a.test}
    sizes = {k: max(4, v // 1000) for k, v in sizes.items()} if a.smoke else sizes
    sentences = io.sentence_source(spark, a.sentences or [], 2 * sum(sizes.values())).select("text")
    pools.build_pools(sentences, pools.template_sentences(spark, seed=str(a.seed)), str(a.seed)).withColumnRenamed("text", "clean").write.mode("overwrite").parquet(f"{a.out}/pool")
    pool = spark.read.parquet(f"{a.out}/pool")  # written once, read for each split and level
    spec = io.read_levels(spark, a.spec) if a.spec else None
    cuts = spark.createDataFrame([(spec["cuts"]["light"], spec["cuts"]["heavy"]) if spec else (10.0, 21.42857142857143)], "light double, heavy double")
    for name, size in sizes.items():
        asked = pool.filter(F.col("split") == name).withColumn("sentence", F.xxhash64("clean")).withColumn("asked_level", F.explode(F.array(*map(F.lit, levels.LEVELS))))
        said = systems.inject.spoken_by_rules(asked.withColumn("utt_id", F.xxhash64("clean", "asked_level")), dial(spark, a.spec), a.seed)
        m = measure.with_level(measure.eligible(measure.measure(said.withColumn("doc_id", F.lit(0).cast("long")), "sentence")), cuts)
        chosen = pools.balanced(m.select("utt_id", "sentence", "level"), "sentence", str(a.seed), size // 4)
        out = said.withColumn("disfluent", F.array_join("disfluent_tokens", " ")).join(chosen.select("utt_id", "level"), "utt_id")
        print(f"  {name}: {io.write_jsonl(out.select('utt_id', 'clean', 'disfluent', 'disfluent_tokens', 'clean_tokens', 'alignment', 'annotations', 'source', 'template_id', 'asked_level', 'level'), f'{a.out}/{name}')} pairs")
    return 0


def _generated(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return io.read_generations(spark, a.generated).select("system", F.col("level").alias("asked_level"), F.xxhash64("system", "level", "utt_id").alias("utt_id"), "clean", "spoken")


def evaluate_systems(spark: SparkSession, a: argparse.Namespace) -> int:
    """Rates, fidelity, type mix and placement of the rule injector beside the corpus; everything is written before figures that may fail."""
    scripts = io.read_jsonl(spark, f"{a.data}/test").filter("clean is not null").dropDuplicates(["clean"]).withColumn("utt_id", F.xxhash64("clean")).orderBy(ordering.seeded(str(a.seed), "utt_id")).limit(a.limit).select("utt_id", "clean")
    asked = scripts.withColumn("asked_level", F.explode(F.array(*map(F.lit, levels.LEVELS))))
    spec = io.read_levels(spark, a.spec)
    said = systems.resolve("rules", levels.dial(spec), a.seed).speak(asked).withColumn("system", F.lit("injector"))
    io.write_generations(said.withColumn("level", F.col("asked_level")), f"{a.out}/generated")
    real = numbered(io.read_jsonl(spark, f"{a.data}/real_eval")).withColumn("system", F.lit("corpus"))
    real = real.orderBy(ordering.seeded(str(a.seed), "utt_id")).limit(a.corpus_limit).select("system", "asked_level", "utt_id", "clean", F.col("disfluent").alias("spoken"))
    both = _generated(spark, argparse.Namespace(generated=f"{a.out}/generated")).unionByName(real)
    found = detect.detected(both).withColumn("n_clean", F.size("clean_tokens")).withColumn("doc_id", F.lit(0).cast("long"))
    m = measure.measure(found, "system")
    targets = spark.createDataFrame([(k, float(levels.targets(spec, k)["total"])) for k in levels.LEVELS], "asked_level int, target double")
    words = io.read_frequencies(spark, a.frequencies)
    rate = report.rate_table(m, F.broadcast(targets))
    tables = {"rate_control": rate, "rate_error": report.rate_errors(rate), "fidelity": report.fidelity_table(found), "type_mix": report.mix_table(m)}
    if not words.isEmpty():
        tables["placement"] = report.placement_table(evaluate.records(found, "system"), found, words)
    io.write_report(tables, f"{a.out}/report")
    for name, t in tables.items():
        print(f"\n## {name}\n\n{markdown(t, ['place'] if 'place' in t.columns else t.columns[:1])}")
    print("\n" + qualitative(said.join(F.broadcast(scripts.limit(a.qualitative).select("utt_id")), "utt_id")))
    return 0


def roundtrip(spark: SparkSession, a: argparse.Namespace) -> int:
    """How much of the scripts a cleaner brings back; the one that is shipped leaves the speech as it is. Patches the report."""
    g = _generated(spark, a)
    own = g.select("system", "asked_level", spoken_text(F.col("clean")).alias("original"), F.col("spoken").alias("recovered"))
    table = report.placed(evaluate.recovery(own, "system", "asked_level"))
    io.patch_report(table, "round_trip", f"{a.out}/report")
    print(markdown(table, ["place"]))
    return 0


def copyfail(spark: SparkSession, a: argparse.Namespace) -> int:
    """Rates and kept words of scripts with and without a word outside the vocabulary (words seen at least twice)."""
    vocabulary = measure.unigrams(io.read_jsonl(spark, a.vocabulary)).filter("n >= 2")
    own = _generated(spark, a).filter(F.col("asked_level") == levels.check(a.level)).withColumn("clean_tokens", canonical_tokens(F.col("clean"))).withColumn("disfluent_tokens", tokens(F.col("spoken")))
    own = own.withColumn("own", F.transform("clean_tokens", spoken_form))
    table = report.copy_failure(own, own, vocabulary)
    io.write_report({"copy_failure": table}, a.out)
    print(markdown(table, ["system", "has_unseen"]))
    return 0


def surprisal(spark: SparkSession, a: argparse.Namespace) -> int:
    """The effect at repair boundaries by source, scored by unigram frequencies."""
    words = io.read_frequencies(spark, a.frequencies, required=True)
    tables = {}
    for path in a.data:
        rows = numbered(io.read_jsonl(spark, path))
        w = evaluate.surprisal_windows(rows.limit(a.limit) if a.limit else rows, words)
        tables[path.rstrip("/").split("/")[-1]] = evaluate.effect_summary(evaluate.bootstrap(w, a.draws, a.seed))
    io.write_report(tables, a.out)
    for name, t in tables.items():
        print(f"\n## {name}\n\n{markdown(t, ['n'])}")
    return 0


def show_levels(spark: SparkSession, a: argparse.Namespace) -> int:
    print(levels.describe(io.read_levels(spark, a.spec)))
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="disfluo", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, *flags: tuple, **defaults) -> None:
        c = sub.add_parser(name, help=run.__doc__)
        for flag, options in flags:
            c.add_argument(flag, **options)
        c.set_defaults(run=run, **defaults)

    number = lambda default: {"type": int, "default": default}
    seed, spec, words = ("--seed", number(13)), ("--spec", {"help": "level specification"}), ("--frequencies", {"default": "data/unigrams"})
    command(
        "speak", speak, ("text", {"nargs": "*"}), ("--level", {"type": int, "choices": levels.LEVELS, "default": 2}), ("--all-levels", {"action": "store_true"}), ("--trace", {"action": "store_true"}), ("--dump", {}),
        ("--system", {"choices": ("rules", "model"), "default": "rules"}), ("--model", {"default": "outputs/model"}), seed, spec)
    share = lambda x: {"type": float, "default": x}
    command("corpus", corpus, ("--root", {}), ("--from-jsonl", {}), ("--out", {"default": "data/corpus"}), ("--split", {"action": "store_true"}), ("--val-fraction", share(0.05)), ("--eval-fraction", share(0.25)), ("--limit", number(0)), seed)
    command("rates", rates, ("--data", {"default": "data/corpus"}), ("--out", {"default": "data/levels"}), words)
    command("detect", check, ("--data", {"default": "data/corpus"}), ("--limit", number(4000)), ("--out", {"default": "outputs/detector"}))
    command("pairs", pairs, ("--sentences", {"action": "append"}), ("--out", {"default": "data"}), ("--train", number(50_000)), ("--val", number(2000)), ("--test", number(10_000)), ("--smoke", {"action": "store_true"}), seed, spec)
    command("evaluate", evaluate_systems, ("--data", {"default": "data"}), ("--out", {"default": "outputs"}), ("--limit", number(1500)), ("--corpus-limit", number(6000)), ("--qualitative", number(30)), seed, ("--spec", {"default": "data/levels"}), words)
    command("roundtrip", roundtrip, ("--generated", {"default": "outputs/generated"}), ("--out", {"default": "outputs"}))
    command("copyfail", copyfail, ("--generated", {"default": "outputs/generated"}), ("--vocabulary", {"default": "data/corpus"}), ("--out", {"default": "outputs/copyfail"}), ("--level", number(2)))
    command("surprisal", surprisal, ("data", {"nargs": "+"}), ("--out", {"default": "outputs/surprisal"}), ("--limit", number(20_000)), ("--draws", number(2000)), seed, words)
    command("levels", show_levels, ("--spec", {"default": "data/levels"}))
    return p


COMMANDS = ("speak", "corpus", "rates", "detect", "pairs", "evaluate", "roundtrip", "copyfail", "surprisal", "levels")


def main(args: list[str] | None = None) -> int:
    args = sys.argv[1:] if args is None else list(args)
    if not args or args[0] not in (*COMMANDS, "-h", "--help"):  # without a command, lines are spoken
        args = ["speak", *args]
    a = parser().parse_args(args)
    return a.run(SparkSession.builder.appName("disfluo").getOrCreate(), a)


if __name__ == "__main__":
    sys.exit(main())
