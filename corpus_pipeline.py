"""A training corpus from the documents table: language, near-duplicates, benchmark overlap,
personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what a stage
returns as Parquet under the shared checkpoint folder and gives it to the next one, so a lost
executor costs at most the current stage. All stages but the last return the columns of ``docs``.

Defined cases, for every stage: an empty table gives an empty result, further columns (also with the
names that a stage uses inside) are kept, a null id stays null, and very long texts are read whole.
Rows are judged one by one but in ``near_duplicates``, so equal rows share their fate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterkit.llm import bpe, decontam, jaccard, langid, pii
from meterkit.llm.common import fresh, quoted, table, written
from meterkit.llm.queries import byte_vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: not ``und``, and a mean probability of MIN_SCORE at
    least. The model learns from the labelled documents that are not held out. A null text, or one
    without a letter, is ``und`` and goes; equal probabilities go to the language that sorts first."""
    model = langid.train(docs)
    lang, score = fresh(docs, "__lang"), fresh(docs, "__score")
    found = langid.predict(docs, model, lang_name=lang, score_name=score)
    return found.where(f"{lang} <> '{langid.UNKNOWN}' and {score} >= {langid.MIN_SCORE}").select(*quoted(docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at five words and a Jaccard similarity of 0.8: the smallest id.
    Null, empty and wordless texts are in no group and stay; of rows with the same id and text one
    stays; rows without an id are judged by their text."""
    return jaccard.keep_one(docs, n=5, percent=80)


def benchmark_overlap(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark. Null, empty and wordless texts stay; items
    without words contaminate nothing."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the new text (a null text or
    n_chars stays null). Overlapping spans become one stretch, named after the first."""
    from pyspark.sql import functions as F

    clean = pii.redact(docs, pii.train())
    if "n_chars" not in docs.columns:
        return clean
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(kind)).select(*quoted(docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's columns besides the text, its number of tokens, and digests of ids and decoded bytes.
    A null or empty text has no tokens."""
    return bpe.token_digests(docs, *byte_vocabulary(), cache_bytes=30 << 20)  # beside what Spark holds after four stages


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_overlap", benchmark_overlap),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: The first and fourth stage decide by trained models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
