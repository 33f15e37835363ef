"""A corpus pipeline: each stage takes what its predecessor kept, and its decisions take effect.

toxicity drops the documents that the model rejects, near_duplicates keeps one document of each class, repeated_strings cuts
long strings that stand in a document with a smaller id, decontamination drops documents that hold test items, and mixing
takes documents to the sources' target weights (``copies`` says how often each is taken).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from disfluo.llm.common import read, stable
from disfluo.llm.decontam import drop_contaminated
from disfluo.llm.mixing import mix_documents
from disfluo.llm.neardup import keep_one
from disfluo.llm.suffixdup import remove_repeats
from disfluo.llm.toxicity import drop_toxic

#: Learned and iterative stages can't be written as SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None

STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one),
    ("repeated_strings", remove_repeats),
    ("decontamination", drop_contaminated),
    ("mixing", mix_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the checkpoint folder before the next one reads them."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stable(docs)
    return docs
