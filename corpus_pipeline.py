"""A corpus pipeline of five stages; each is one of the operators of rimflow.llm.

A stage takes (spark, docs, sf_dir) and returns documents; run() writes what a stage returns as Parquet in
the shared folder and reads it again as the next one's docs.

Defined results: every stage judges each row by its own text, whatever its doc_id, and a text of any length whole, in the memory of one
row. Null and empty texts fail the rules and so do not come further; null lang and source are groups of their own. Repeated rows stay or go
together; of near duplicates the row with the smallest doc_id stays, and rows without a doc_id do. Mixing repeats rows and drops none.
Columns of the input beyond those of documents go through the first four stages as they are, also where their names are those of a
computed column; the last stage returns doc_id, n_tokens and ids. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rimflow.llm.bpe import encode_stage
from rimflow.llm.mixing import mix_stage
from rimflow.llm.neardup import keep_one_of_each
from rimflow.llm.quality_classifier import keep_by_classifier
from rimflow.llm.quality_rules import keep_by_rules
from rimflow.llm.shared import stored, table

STAGES = [
    ("quality rules", keep_by_rules),
    ("quality classifier", keep_by_classifier),
    ("near duplicates", keep_one_of_each),
    ("mixing", mix_stage),
    ("bpe", encode_stage),
]

#: No SQL for run(): the classifier, the sketches and the tokenizer are beyond it; tests use brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name.replace(" ", "_"))
    return docs
