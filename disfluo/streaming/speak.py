"""The row-local operators over streams: speech for scripts as they arrive, and events found in pairs as they arrive.

Both are stateless maps, so they need neither a watermark nor a checkpointed state beyond the source's offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from disfluo.operators import corpus, detect


def spoken_stream(scripts: DataFrame, seed: str = "say") -> DataFrame:
    """A stream of (utt_id, doc_id, asked_level, clean, clean_tokens, n_clean) to utterances with speech and annotations."""
    return corpus.spoken(scripts, seed)


def detected_stream(pairs: DataFrame) -> DataFrame:
    """A stream of (utt_id, clean, spoken) to one row for each insertion."""
    return detect.trace(detect.detected(pairs))


def event_counts(spoken: DataFrame) -> DataFrame:
    """Running counts of events of each level and type: a streaming aggregation whose state is at most 16 rows."""
    e = spoken.select("asked_level", F.explode("annotations").alias("a"))
    return e.groupBy("asked_level", F.col("a.type").alias("type")).agg(F.count("*").alias("n"))
